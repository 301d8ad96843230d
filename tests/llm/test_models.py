"""Trained operators: defined results on awkward rows, held-out accuracy, and exact parts against plain versions."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthstat.llm import gru, lm_scoring, quality, toxicity, word_hashes

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1 - (i == 13), int(i == 13)) for i in range(5, 60)] + [(13, 1, 1)], "doc_id long, quality int, toxic int").selectExpr("*", "'x' as text")


def test_toxicity_rows(docs, labels, none):
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0) for r in got)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_windows_cover_the_text():
    text = "Some Words, and more! " * 40 + "x" * 500
    assert b"".join(toxicity.windows(text)) == b" " + b" ".join(text.encode().translate(toxicity._PLAIN).split())


def test_toxicity_features():
    """Against whole-text compression of each window, one after the other."""
    import zstandard as z

    ordinary, bad = b"the quick brown fox jumps over the lazy dog and the other things", b" idiot moron scoundrel" * 3
    text = "The quick brown idiot and the other, things over scoundrel! The lazy dog jumps."

    def size(w, d):
        p = z.ZstdCompressionParameters(compression_level=1, min_match=5, strategy=z.STRATEGY_GREEDY, window_log=15, search_log=3, hash_log=14, chain_log=14, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(z.ZstdCompressor(dict_data=z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p).compress(w))

    saved = sorted((size(w, ordinary) - size(w, bad) for w in toxicity.windows(text)), reverse=True)
    got = toxicity.features(text, ordinary, bad)
    assert got[:3] == saved[:3] and got[0] > 0 and math.isclose(got[3], sum(saved) / len(saved))
    assert got[4:-1] == [math.log1p(sum(x >= s for x in saved)) for s in toxicity.SAVED] and got[-1] == math.log(len(saved))


def test_toxicity_short_words():
    """A word of four letters and the space before it are as long as a match, so it is a sample of its own."""
    assert toxicity.word_beginnings("Scum, of it") == {b"scum"}
    out = next(toxicity._pieces(frozenset([b"scum"]))([pa.RecordBatch.from_pydict({"text": ["a SCUM scumbag, it"]})]))
    assert out.column("sample").to_pylist() == [b" scum", b" scum"]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    d, y = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_toxicity(d, y).filter("held_out").join(y, "doc_id").collect()
    bad, good = [r["score"] for r in rows if r["toxic"]], [r["score"] for r in rows if not r["toxic"]]
    assert sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / (len(bad) * len(good)) > 0.85


def test_toxicity_calibration_keeps_the_share_of_classes_beyond_the_caps(spark, monkeypatch):
    g = np.random.default_rng(4)
    y = (g.random(40_000) < 0.11).astype(float)
    x = (y + g.standard_normal(len(y)))[:, None]
    some = np.r_[np.flatnonzero(y == 1), np.flatnonzero(y == 0)[: int(2 * y.sum())]]  # a third is toxic, as under both caps
    p = toxicity.apply_logistic(x, toxicity.fit_logistic(x[some], y[some], share=y.mean()))
    assert abs(p.mean() - y.mean()) < 0.01
    seen, real = [], toxicity.fit_logistic
    monkeypatch.setattr(toxicity, "fit_logistic", lambda *a, **k: seen.append((a[1].mean(), k["share"])) or real(*a, **k))
    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxicity.train(d, labels, ordinary_rows=40)
    toxicity.train(d, labels)
    (capped, share), (every, same) = seen
    assert math.isclose(share, same) and abs(every - same) < 0.05 and capped > 1.5 * share


def test_quality_rows(docs, labels, none):
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(none, labels).count() == 0
    assert all(r["keep"] for r in quality.score_quality(docs, labels.limit(0)).collect())
    assert quality.only_good(docs, labels.limit(0)).columns == docs.columns


def test_quality_accuracy(spark):
    d, y = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score_quality(d, y).join(y, "doc_id").collect()
    good, bad = [r["keep"] for r in rows if r["quality"]], [r["keep"] for r in rows if not r["quality"]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.3


def test_gradients():
    """Backpropagation within a window equals numerical differences."""
    g = np.random.default_rng(1)
    seqs = [g.integers(0, 4 * gru.LEAVES, k) for k in (7, 5, 3, 9)]
    weights = gru.start(np.ones((4, gru.LEAVES)) * 5).astype(np.float64)
    weights += g.standard_normal(len(weights)) * 0.05
    loss = lambda x: -gru.score(gru.views(x, 4), seqs).sum()
    seen = {}
    real, gru._adam = gru._adam, lambda w, slopes, *_: seen.update(slopes=slopes.copy())
    try:
        gru.train(weights.copy(), 4, [*seqs], {})
    finally:
        gru._adam = real
    at = gru.views(np.arange(len(weights)), 4)
    some = {k: g.choice(v.ravel(), 6) for k, v in at.items()} | {"E": at["E"][:, seqs[3][:4]].ravel(), "R": at["R"].ravel()}
    for k, v in some.items():
        for i in v:
            up, down = weights.copy(), weights.copy()
            up[i] += 1e-4
            down[i] -= 1e-4
            assert math.isclose((loss(up) - loss(down)) / 2e-4, seen["slopes"][i], rel_tol=1e-3, abs_tol=1e-5), k


def test_scores_do_not_depend_on_the_sequences_beside():
    """State runs over a whole sequence and starts anew with the next, however sequences share streams."""
    g = np.random.default_rng(2)
    m = gru.views(gru.start(np.ones((4, gru.LEAVES))).astype(np.float64), 4)
    seqs = [g.integers(0, 4 * gru.LEAVES, n) for n in (1, 70, 3, 200, 24, 25, 0, 2, 48)]
    alone = [gru.score(m, [s])[0] for s in seqs]
    for streams in (1, 2, 4, 64):
        assert np.allclose(gru.score(m, seqs, streams), alone)


def test_lm_scores(docs, rows, none):
    got = lm_scoring.score_documents(docs).collect()
    tokens = lambda x: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or "")) + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter(t for i, x in rows if not out(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = sorted((i is None, i or 0, out(i), len(tokens(x)), sum(c[t] > 0 for t in tokens(x)), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in rows)
    assert sorted((r[0] is None, r[0] or 0, r[1], r[2], r[3], r[4], round(r[5], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got) and lm_scoring.score_documents(none).count() == 0


def test_lm_does_not_depend_on_partitions(spark, monkeypatch):
    """Lanes are dealt by a hash of the document, so scores are the same however the table lies."""
    monkeypatch.setattr(lm_scoring, "LANE", 20_000)
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    by_id = lambda n: {r["doc_id"]: r["score"] for r in lm_scoring.score_documents(d.repartition(n)).collect()}
    one, eight = by_id(1), by_id(8)
    assert one.keys() == eight.keys() and all(math.isclose(one[k], eight[k], rel_tol=1e-4) for k in one)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbZé \n\t\r\x0b\x1c\x85\u2028ß"), max_size=40), max_size=6))
def test_word_hashes(texts):
    h, last, n = word_hashes.words_of(pa.array(texts, pa.string()))
    words = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode()).split() for t in texts]
    assert n.tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    assert last.tolist() == [(w[-2] * 256 if len(w) > 1 else 0) + w[-1] for w in flat]
    assert all((a == b) == (x == y) for a, x in zip(flat, h.tolist(), strict=True) for b, y in zip(flat, h.tolist(), strict=True))


def test_word_hashes_over_slices(monkeypatch):
    text = pa.array([" ".join(f"w{i}" for i in range(5000)), "x" * 3000, "", "w1 " * 2000])
    want = word_hashes.words_of(text)
    monkeypatch.setattr(word_hashes, "SLICE", 100)
    assert all((a == b).all() for a, b in zip(word_hashes.words_of(text), want, strict=True))


def test_lm_probabilities_add_up():
    m = gru.views(gru.start(np.arange(4.0 * gru.LEAVES).reshape(4, -1)), 4)
    every = [np.array([5, t]) for t in range(4 * gru.LEAVES)]
    first = gru.score(m, [np.array([5])])[0]
    assert math.isclose(np.exp(gru.score(m, every) - first).sum(), 1, rel_tol=1e-4)


def test_lm_second_factors_of_a_place_add_up(spark, docs):
    """Words of a place share its probability, and what is left is for words that training lacks."""
    rows = docs.selectExpr("text").filter("text is not null")
    v = lm_scoring.vocabulary(lm_scoring.count_tokens(rows))
    known, ids, _, own = v.tables()
    assert len(known) == v.distinct and (own[: lm_scoring.WORDS] == 0).all()
    for place in range(lm_scoring.PLACES):
        mine = 10 ** own[lm_scoring.WORDS :][v.places[lm_scoring.WORDS :] == place]
        assert math.isclose(mine.sum() + 1 / (v.n[place] + v.v[place] + 1), 1)


def test_lm_beats_unigrams_on_held_out_text(spark):
    rows = lm_scoring.score_documents(spark.read.parquet(f"{SF}/documents.parquet")).filter("held_out").collect()
    assert sum(r["score"] - r["base_score"] for r in rows) > 0.2 * sum(r["n_tokens"] for r in rows)
