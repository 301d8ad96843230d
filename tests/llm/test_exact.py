"""Operators whose results are exact, against plain versions without Spark."""

import hashlib
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from hearthstat.llm import decontamination, fingerprints, hamming, line_chunks, mixing, simhash_dedup, token_counts, wavelet
from hearthstat.llm.encoding import byte_level_counter, word_encoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = st.text(alphabet=st.sampled_from("aAbZ09 '\n\t\r\x0b\x1c\x85 ᠎​　éß́ΣσIİ.,!<|endoftext>s're"), max_size=60)


LIBRARY = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_encoders_equal_the_library(text):
    assert byte_level_counter(BYTE)(text) == len(LIBRARY[BYTE].encode(text, add_special_tokens=False).ids)
    assert np.frombuffer(word_encoder(WORD)(text), "<u4").tolist() == LIBRARY[WORD].encode(text, add_special_tokens=False).ids


def test_token_counts(spark, docs, rows, none, folder):
    t = Tokenizer.from_file(BYTE)
    want = sorted((i is None, i or 0, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x in rows)
    for _ in range(2):  # the second run finds all in the cache
        got = token_counts.count_tokens(docs, BYTE, folder("cache")).collect()
        assert sorted((r[0] is None, r[0] or 0, *r[1:]) for r in got) == want
    stored = spark.read.parquet(folder("cache"))
    assert stored.count() == stored.select("digest").distinct().count() == len({x or "" for _, x in rows})
    assert token_counts.count_tokens(none, BYTE, folder("other")).count() == 0


def plain_simhash(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    h = [xxh64_intdigest(" ".join(words[i : i + k]), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(words, radius):
    words = sorted(words)
    root = {w: w for w in words}

    def find(w):
        while root[w] != w:
            w = root[w]
        return w

    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {w: find(w) for w in words}


def test_near_duplicates(docs, rows, none):
    got = simhash_dedup.near_duplicates(docs).collect()
    fp = {x: plain_simhash(x or "") for _, x in rows}
    of = plain_components(set(fp.values()), 4)
    first = {}
    for i, x in rows:
        if i is not None:
            first[of[fp[x]]] = min(i, first.get(of[fp[x]], 1 << 60))
    want = [(i, f"{fp[x]:016x}", first.get(of[fp[x]])) for i, x in rows]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {w[2] for w in want} and kept.count() == len(set(of[f] for f in fp.values()))


def test_near_duplicates_keep_null_and_shared_ids(spark):
    rows = [(None, "alpha " * 9), (1, "alpha " * 9), (2, "zzz one two three four"), (2, "other text with words of its own"), (None, "no id at all, a text apart"), (3, ""), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' as key", "'r' as row")
    kept = simhash_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([*rows[1:6]], key=str)


@pytest.mark.parametrize(("radius", "scheme"), [(4, hamming.multi_index_keys), (3, hamming.permuted_block_keys)])
@pytest.mark.parametrize("dense", [1024, 12])
def test_dense_and_chained_fingerprints(spark, radius, scheme, dense):
    g = np.random.default_rng(5)
    words = {int(x) for x in g.integers(0, 1 << 63, 20)} | {0}
    for centre in list(words)[:2]:
        words |= {centre ^ sum(1 << int(b) for b in g.choice(64, g.integers(1, 4), replace=False)) for _ in range(25)}
    chain = 12345
    for b in range(0, 40, radius):  # each link at exactly the radius
        chain ^= sum(1 << (b + i) for i in range(radius) if b + i < 64)
        words.add(chain)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(w),) for w in words], "fp long")
    got = {r["node"]: r["root"] for r in hamming.components(hamming.links_within(fps, radius, scheme, dense)).collect()}
    groups = lambda of: {frozenset(a for a in words if of(a) == r) for r in {of(w) for w in words}}
    want = plain_components(words, radius)
    assert groups(lambda w: got.get(signed(w), signed(w))) == groups(want.get)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=1500))
def test_wavelet_matrix(ids):
    x = np.array(ids, np.uint32)
    doc_ids, n, w = wavelet.unpack(wavelet.pack([5, 9], [len(x) // 2, len(x) - len(x) // 2], x))
    assert doc_ids.tolist() == [5, 9] and n.sum() == len(x) and w.decode().tolist() == ids
    for token in {*ids[:5], 3}:
        at = [i for i, y in enumerate(ids) if y == token]
        assert w.count(token) == len(at) and [w.select(token, j) for j in range(len(at))] == at
        assert w.rank(token, len(ids) // 2) == sum(i < len(ids) // 2 for i in at)
    assert [w.access(i) for i in range(0, len(ids), 37)] == ids[::37]


def test_wavelet_shards(spark, docs, rows, none, folder):
    t = Tokenizer.from_file(WORD)
    wavelet.write_shards(docs, WORD, folder("shards"), shard_tokens=300)
    got = sorted(map(tuple, wavelet.read_shards(spark, folder("shards")).collect()), key=lambda r: r[1])
    start = 0
    for (i, x), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)), got, strict=True):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        assert r == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    shards = spark.read.parquet(folder("shards"))
    assert shards.count() > 3 and len(shards.inputFiles()) == shards.count()
    assert wavelet.encode_corpus(none, WORD, folder("nothing")).count() == 0


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    size = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    source = [(r["source"], size(r["text"])) for r in docs.collect()]
    names = sorted({s for s, _ in source if s is not None}) + [None]
    total = {s: sum(n for x, n in source if x == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    capped = set()
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in capped)
        scale = left / sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and scale * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    want = {s: 3 * total[s] if s in capped else scale * weight[s] for s in names}
    assert sorted((r["size"], r["source_size"], round(r["target"], 6)) for r in got) == sorted((n, total[s], round(want[s], 6)) for s, n in source)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in names:
        mine = [r for r in got if r["source_size"] == total[s] and math.isclose(r["target"], want[s])]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max([r["size"] for r in mine], default=0) / 2 + 1e-6
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {}
    for r in out.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + size(r["text"])
    told = {}
    for r in got:
        told[r["doc_id"]] = told.get(r["doc_id"], 0) + r["taken"]
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in told.items() if v}


def test_positions_follow_the_schedules(spark, docs):
    """Each copy stands where its source's integrated weight has made as many words due, and rows come in that order."""
    rows = mixing.schedule(mixing.plan(docs)).collect()
    assert len(rows) == sum(r["copies"] for r in mixing.plan(docs).collect())
    slopes = dict(zip((1.0, 2.0, 3.0), mixing.SLOPES, strict=True))
    for r in rows:
        a, t = slopes[r["weight"]], r["position"]
        due = min(1.0, (r["copy"] * r["source_size"] + r["before"] + r["size"] / 2) / r["target"]) if r["target"] else 0.0
        steps = 20_000  # the integral of 1 - a + 2 a u over [0, t], added up
        area = sum(1 - a + 2 * a * (t * (i + 0.5) / steps) for i in range(0, steps, 200)) * 200 * t / steps
        assert 0 <= t <= 1 and abs(area - due) < 0.01
    clash = docs.selectExpr("*", "1 as _key", "2 as _nth", "3 as name", "4 as nth", "5 as place")
    out = mixing.mixed(clash)
    assert out.columns == clash.columns and {(r["_key"], r["_nth"], r["name"], r["nth"], r["place"]) for r in out.collect()} == {(1, 2, 3, 4, 5)}
    place = {}
    for r in rows:
        place.setdefault(r["doc_id"], []).append(r["position"])
    got = [r["doc_id"] for r in mixing.mixed(docs).collect()]
    single = [place[i][0] for i in got if len(place[i]) == 1]
    assert single == sorted(single) and len(got) == len(rows)


def test_mix_places_every_copy(spark, docs):
    """What the query gives comes from the mix in its order: every copy has its place, after the words of those before it."""
    docs = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in mixing.mix(docs.repartition(5)).collect()}
    copies = sorted((r["position"], r["key"], r["copy"], r["doc_id"], r["size"]) for r in mixing.schedule(mixing.plan(docs)).collect() if r["size"])
    at, want, first = 0, {}, {}
    for position, _, _, doc_id, size in copies:
        want.setdefault(doc_id, []).append(at)
        first.setdefault(doc_id, position)
        at += size
    assert max(map(len, want.values())) > 1 and len({c[0] for c in copies}) == len(copies)  # no ties
    sized = {i: r for i, r in got.items() if r["size"]}
    assert {i: r["starts"] for i, r in sized.items() if r["starts"]} == want and {i: r["first_position"] for i, r in sized.items() if r["starts"]} == first
    assert all(r["taken"] == r["size"] * len(r["starts"]) for r in got.values())


def test_fingerprints(docs, rows, none):
    got = {(r["doc_id"], r["edited_sha256"]): r for r in fingerprints.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(((i, x or "") for i, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for k, (i, x) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(x) // 4
        e = x[: len(x) - n] + after[:n]
        r = got[i, hashlib.sha256(e.encode()).hexdigest()]
        a, b, c = map(fingerprints.weighted_simhash, (x, e, after))
        assert r["n_chars"] == len(x) and (r["fingerprint"], r["edited_fingerprint"]) == (f"{a:016x}", f"{b:016x}")
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64 and r["near_next"] == 1 - (a ^ c).bit_count() / 64
    of = plain_components({fingerprints.weighted_simhash(x) for _, x in order}, 3)
    for i, x in order:
        mine = of[fingerprints.weighted_simhash(x)]
        assert {r["class_id"] for k, r in got.items() if k[0] == i} == {min((j for j, y in order if j is not None and of[fingerprints.weighted_simhash(y)] == mine), default=None)}
    assert fingerprints.fingerprint_documents(none).count() == 0
    again = fingerprints.edited_pairs(docs, range_bytes=2000)
    assert sorted(map(str, again.collect())) == sorted(map(str, fingerprints.edited_pairs(docs).collect()))


def plain_tiles(item, doc, least):
    """Greedy string tiling as first published: the longest free matches, again and again, by comparing all places."""
    item, doc, got = list(item), list(doc), []
    while True:
        best = (least - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                k = 0
                while i + k < len(item) and j + k < len(doc) and item[i + k] == doc[j + k] and item[i + k] >= 0:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return got
        k, i, j = best
        item[i : i + k], doc[j : j + k] = [-1] * k, [-2] * k
        got.append((i, j, k))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.integers(0, 4), max_size=60), st.integers(2, 4))
def test_tiles(item, doc, least):
    got = decontamination.tiles(np.array(item, int), np.array(doc, int), least)
    for i, j, k in got:
        assert k >= least and item[i : i + k] == doc[j : j + k]
    for at in (0, 1):
        places = [t[at] + d for t in got for d in range(t[2])]
        assert len(places) == len(set(places))
    assert sorted(got) == sorted(plain_tiles(item, doc, least))


def test_tiles_of_one_repeated_word_take_no_squares():
    began = time.time()
    assert decontamination.tiles(np.zeros(8_000, int), np.zeros(1_000_000, int), 4) == [(0, 0, 8_000)]
    block = decontamination.Items([(1, "a " * 300), (2, "a b " * 200)], 4)
    assert block.match("a " * 1_000_000, 0.5) == [(1, 1.0, 1)]
    assert block.match("a b " * 500_000, 0.5)[-1] == (2, 1.0, 1)
    assert time.time() - began < 60


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 4), max_size=25), min_size=1, max_size=4), st.lists(st.integers(0, 6), max_size=60), st.sampled_from([0.3, 0.5, 0.9]))
def test_matches_against_tiling_of_every_pair(items, doc, threshold):
    text = lambda ids: " ".join(f"w{i}" for i in ids)
    got = decontamination.Items([(k, text(x)) for k, x in enumerate(items)], 4).match(text(doc), threshold)
    want = []
    for k, x in enumerate(items):
        all_tiles = plain_tiles(x, doc, min(4, len(x))) if x else []
        share = sum(t[2] for t in all_tiles) / max(1, len(x))
        if x and share >= threshold:
            want.append((k, share, len(all_tiles)))
    assert sorted(got) == want


def test_leaks(spark):
    words = [f"b{i}" for i in range(40)]
    items = [(1, " ".join(words)), (2, "short one"), (3, None), (4, ""), (5, " ".join(f"c{i}" for i in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "0 as doc_id")
    parts = [words[30:], words[:10], words[20:30], words[10:20]]
    rows = [
        (1, "x y " + " ".join(words).upper() + " z"), (2, "; ".join(" ".join(p) for p in parts)), (3, " ".join(words[:15])), (4, None), (5, ""),
        (6, "a short, one"), (7, " ".join(w for x in words for w in (x, "filler"))), (8, " ".join(f"c{i}" for i in range(11)) + " other"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' as item_id")
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 4), r["n_tiles"]) for r in decontamination.leaks(docs, bench).collect()}
    assert got == {(1, 1): (1.0, 1), (2, 1): (1.0, 4), (6, 2): (1.0, 1), (8, 5): (0.55, 1)}
    assert sorted(r["doc_id"] for r in decontamination.without_leaks(docs, bench).collect()) == [3, 4, 5, 7]
    small = decontamination.leaks(docs, bench, block_bytes=100).collect()
    assert {(r["doc_id"], r["item_id"]): (round(r["coverage"], 4), r["n_tiles"]) for r in small} == got
    assert decontamination.leaks(docs.limit(0), bench).count() == 0 and decontamination.leaks(docs, bench.limit(0)).count() == 0


def test_rows_without_leaks_keep_their_columns(spark):
    words = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([("x1", words)], "item_id string, text string")
    rows = [(None, "clean", 1), (None, words, 2), (5, words, 3), (5, "shares its id", 4), (6, None, 5), (6, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _bad int").selectExpr("*", "'k' as key", "'r' as row")
    out = decontamination.without_leaks(docs, bench)
    assert out.columns == docs.columns
    assert sorted((r["_bad"], r["key"], r["row"]) for r in out.collect()) == [(1, "k", "r"), (4, "k", "r"), (5, "k", "r"), (5, "k", "r")]
    named = decontamination.leaks(docs.selectExpr("concat('d', _bad) as doc_id", "text"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in named) == [("d2", "x1"), ("d3", "x1")]


def test_line_chunks(docs, none, tmp_path):
    import duckdb

    got = line_chunks.dedup_lines(docs).collect()
    documents = docs.toPandas()  # noqa: F841
    c = duckdb.connect()
    c.register("documents", docs.select("doc_id", "text").toArrow())
    want = c.sql(line_chunks.SQL).fetchall()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    texts = {r["doc_id"]: r for r in got}
    assert texts[0]["text"] is None and texts[1]["text"] == "" and texts[10]["n_removed"] == 24
    assert texts[9]["n_removed"] == 0 and texts[10]["text"] == "other start\ntail ten"
    assert line_chunks.dedup_lines(none).count() == 0


def plain_chunks(lines, divisor, longest):
    """(first, last) of what counts as a chunk, read off the rule."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    begins, since = [], 0
    for i in range(len(lines) - 1):
        if i == 0 or (h[i] * 31 + h[i + 1]) % divisor or i - since == longest:
            begins.append(i)
            since = i
    out = []
    for k, s in enumerate(begins):
        end = begins[k + 1] if k + 1 < len(begins) else len(lines)
        out += [(s, e) for e in range(s + 1, max(s + 2, min(end + 1, len(lines))))]
        out += [(b, s + 1) for b in range(begins[k - 1] + 1 if k else 0, s)]
    return out


@pytest.mark.parametrize("seed, divisor", [(0, 2), (1, 3), (2, line_chunks.DIVISOR), (3, 1)])
def test_repeated_chunks_go(spark, seed, divisor):
    g = np.random.default_rng(seed)
    rows = [(int(g.integers(0, 30)), "\n".join(f"line {g.integers(0, 25)}" for _ in range(g.integers(1, 12)))) for _ in range(40)]
    rows += rows[:4] + [(None, rows[5][1]), (50, "a\nb"), (50, "a\nb"), (51, "b\na\nb"), (52, ""), (53, "\n".join(["same"] * 40)), (54, "x\n" + "\n".join(["same"] * 21))]
    seen, want = set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    for i, text in order:
        lines, gone = text.split("\n"), set()
        for first, last in sorted(plain_chunks(lines, divisor, line_chunks.LONGEST)):
            chunk = "\n".join(lines[first : last + 1])
            if chunk in seen:
                gone |= set(range(first, last + 1))
            seen.add(chunk)
        want.append((i, "\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    got = line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), divisor).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_boundaries_decide_what_goes(spark):
    """Passages go whole where a boundary lies in them; the rolling hash, not every pair of lines, decides."""
    passage = [f"shared {i} of it" for i in range(6)]
    rows = [(k, "\n".join([f"own {k}", *passage, f"tail {k}"])) for k in range(4)]
    gone = {d: {r["doc_id"]: r["n_removed"] for r in line_chunks.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), d).collect()} for d in (1, 2, 8, 10**6)}
    assert gone[8] == gone[10**6] == gone[2] == {0: 0, 1: 6, 2: 6, 3: 6}
    assert set(gone[1].values()) == {0}  # no boundary but each text's first line: no chunk is shared


def test_line_chunks_of_a_long_document(spark):
    text = "\n".join(f"line {i}" for i in range(200_000))
    began = time.time()
    got = sorted(map(tuple, line_chunks.dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nmore")], "doc_id long, text string")).select("doc_id", "n_lines", "n_removed").collect()))
    assert got == [(1, 200_000, 0), (2, 200_001, 200_000)] and time.time() - began < 60
