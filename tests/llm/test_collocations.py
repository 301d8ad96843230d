"""Phrase mining against plain counts of every phrase."""

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthstat.llm import collocations as P

ODD = st.text(alphabet=st.sampled_from("aAbZ \t\n\r\x0b\x0c.,;:!?-é\xa0　"), max_size=60)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def pieces(t):
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower(t))]


@settings(max_examples=200, deadline=None)
@given(st.lists(ODD, max_size=6), st.integers(1, 40))
def test_words(texts, slice_bytes):
    before, P.SLICE = P.SLICE, slice_bytes
    try:
        raw, h, piece, of, first, end = P.words_of(pa.array(texts, pa.string()))
    finally:
        P.SLICE = before
    words = [(raw[a:b].tobytes().decode(), int(x)) for a, b, x in zip(first, end, of, strict=True)]
    assert words == [(w, i) for i, t in enumerate(texts) for p in pieces(t) for w in p]
    runs = [len(p) for t in texts for p in pieces(t) if p]
    assert sorted(Counter(piece.tolist()).values()) == sorted(runs) and piece.tolist() == sorted(piece.tolist())
    names = {}
    for (w, _), x in zip(words, h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def plain(rows, support, most):
    f, n = Counter(), Counter()
    for lang, t in rows:
        lang = "und" if lang is None else lang
        for w in pieces(t):
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {p: x for p, x in f.items() if x >= support}
    out = []
    for p, a in f.items():
        lang, w = p[0], p[1:]
        if len(w) < 2:
            continue
        longer = [q for q in f if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q) - len(w) + 1))]
        if any(100 * f[q] >= 80 * a for q in longer):
            continue
        score, k = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[(lang, *w[:k])], f[(lang, *w[k:])], n[lang], score))
    done = []
    for lang in n:
        best = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        done += [(x[0], r, *x[1:]) for r, x in enumerate(best, 1)]
    return sorted(done)


@pytest.mark.parametrize("support, most", [(2, 2000), (3, 5), (7, 2000), (30, 2000)])
def test_awkward_documents(spark, docs, none, support, most):
    more = [(200 + i, f"New York city. NEW york\tcity, {'x' * (i % 3)} and the end: and the", [None, "und", "", "en"][i % 4], "a") for i in range(24)]
    more += [(None, "and the end and the end and the end", "en", None)] * 3 + [(300, "zz " * 20_000, "zz", "a")]
    df = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")).selectExpr("*", "'p' as phrase", "1 as shard", "2 as size", "3 as n")
    want = plain([(r["lang"], r["text"]) for r in df.collect()], support, most)
    for d in (df, df.repartition(9)):
        assert sorted(map(tuple, P.mine(d, support, most=most).collect())) == want
    if support == 30:
        assert P.mine(none, support).count() == 0


def test_small_bitmaps_lose_nothing(spark):
    rows = [(i, " ".join(f"w{(i * j) % 41}" for j in range(60)), "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = plain([(r[2], r[1]) for r in rows], 30, 2000)
    assert want and sorted(map(tuple, P.mine(df, bits=9).collect())) == want


def test_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    got = P.mine(spark.read.parquet(path))
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"SELECT {', '.join(got.columns)} FROM ({P.SQL})").fetchall())


def test_counts_past_64_bits(spark):
    """Scores of counts whose products need more than 64 bits."""
    a, lr = 9_000_000_000_000_000, 9_100_000_000_000_000
    got = spark.sql(f"SELECT cast((2000000BD * cast({a}L AS decimal(20, 0))) div (cast({lr}L AS decimal(20, 0)) + cast({lr}L AS decimal(20, 0))) AS long) AS s").first()["s"]
    assert got == 2000000 * a // (2 * lr)
