"""Toxicity by compression distance.

Two zstandard dictionaries are trained by the library on labelled texts of their own class: the ordinary one on whole
ordinary texts, the toxic one on what sets toxic texts apart.  Most of a toxic text is ordinary too, and the trainer
would fill the dictionary with that; so its samples are the occurrences, in toxic texts, of word beginnings whose
document frequency there is over ``RATIO`` times that of ordinary texts, beyond chance (``STANDS_OUT``).  Each window of a text is compressed
with either dictionary; by how much the toxic one makes it shorter is the window's distance.  Windows overlap nowhere and
cover the whole text.

A document's largest distances, their mean, and its counts of windows beyond fixed distances are turned into a
probability by a logistic calibration on labelled texts that neither dictionary was trained on.  Labels serve training
only; language, source and id are no inputs.

Scale: training uses a bounded sample of labelled rows: about ``TOXIC`` and ``ORDINARY`` rows and ``BYTES`` of text a
class, drawn by a hash of id and text, each read whole; a text of over a sixteenth of ``BYTES`` is not drawn (it is
scored whole like any other).  Of these, ``SHARE`` of ten parts train the dictionaries and the rest the calibration, whose
intercept is moved to the share of toxic rows among all training rows.  Scoring is one scan without a shuffle; the model
is about 10 kB.

Defined results: null and empty texts have no window and get the score of a text without distances; conflicting labels
of one id count as toxic; repeated rows repeat, in training too; if either class has no training row every score is the
share of toxic training rows (0 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

TOXIC, ORDINARY, BYTES = 6_000, 12_000, 32 << 20
SHARE = 6  # tenths of the sample that train the dictionaries
WINDOW = 20  # bytes
ORDINARY_BYTES, TOXIC_BYTES = 8192, 2048
STANDS_OUT, RATIO = 20.0, 12.0  # likelihood ratio, and share of toxic texts against that of ordinary ones
SHORTEST, LONGEST = 4, 12  # bytes of a word beginning; with the space before it the least is what the compressor matches
SAVED = (1, 2, 3, 4, 5, 6)
ROWS = 2048  # of a logistic fit that are weighed at once
#: The three offsets that end a trained dictionary's tables, fixed by the format's trainer; content follows.
OFFSETS = b"\x01\x00\x00\x00\x04\x00\x00\x00\x08\x00\x00\x00"
#: A-Z to a-z, other ASCII but letters and digits to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def windows(text: str, size: int = WINDOW) -> list[bytes]:
    """The words of the text in order, cut before words where one begins late enough in a window."""
    b = b" " + b" ".join(text.encode().translate(_PLAIN).split())
    out, i, n = [], 0, len(b)
    while i < n:
        e = min(n, i + size)
        if e < n:
            cut = b.rfind(b" ", i + size // 3, e)
            e = cut if cut > i else e
        out.append(b[i:e])
        i = e
    return out


def word_beginnings(text: str) -> set[bytes]:
    words = {w for w in set(text.encode().translate(_PLAIN).split()) if len(w) >= SHORTEST}
    return {w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)}


@cache
def _compressor(dictionary: bytes):
    """Matches are what differs between the two: the trained content serves without its tables of literals."""
    import zstandard as z

    p = z.ZstdCompressionParameters(
        compression_level=1, min_match=5, strategy=z.STRATEGY_GREEDY, window_log=15, search_log=3, hash_log=14, chain_log=14,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=p)


def distances(text: str, ordinary: bytes, toxic: bytes) -> np.ndarray:
    """Of each window, the compressed bytes that the toxic dictionary saves against the ordinary one."""
    one, other = _compressor(ordinary).compress, _compressor(toxic).compress
    return np.array([len(one(w)) - len(other(w)) for w in windows(text)] if text else [0.0], float)


def features(text: str, ordinary: bytes, toxic: bytes) -> list[float]:
    saved = distances(text, ordinary, toxic)
    top = np.sort(saved)[::-1][:3]
    return [*top, *[0.0] * (3 - len(top)), saved.mean(), *[math.log1p((saved >= s).sum()) for s in SAVED], math.log(len(saved))]


def _terms(batches):
    counts = [Counter(), Counter()]

    def rows():
        terms = [*counts[1], *(t for t in counts[0] if t not in counts[1])]
        for i in range(0, len(terms), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), *(pa.array([c[t] for t in part], pa.int64()) for c in counts[::-1])], ["term", "toxic", "ordinary"])

    for b in batches:
        for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
            counts[toxic].update(word_beginnings(text))
        if sum(map(len, counts)) > 500_000:
            yield from rows()
            counts = [Counter(), Counter()]
    yield from rows()


def _pieces(strong: frozenset):
    def run(batches):
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                for w in text.encode().translate(_PLAIN).split():
                    k = next((k for k in range(min(LONGEST, len(w)), SHORTEST - 1, -1) if w[:k] in strong), 0)
                    if k:
                        out.append(b" " + w[:k])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sample"])

    return run


def _windows(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for t in b.column("text").to_pylist() for w in windows(t, 64)], pa.binary())], ["sample"])


def dictionary(samples: list[bytes], size: int, **parameters) -> bytes:
    """The content that zstandard's trainer selects, without the tables before it; of too few samples for it, the samples
    themselves."""
    import zstandard

    try:
        whole = zstandard.train_dictionary(size, samples, **parameters).as_bytes()
        return whole[whole.index(OFFSETS) + len(OFFSETS) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:].rjust(8)


def _features(ordinary: bytes, toxic: bytes):
    def run(batches):
        for b in batches:
            x = [features(t, ordinary, toxic) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, share: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, scales and weights (the last is the intercept), by Newton steps.

    ``share``: the share of ones where rows were sampled by class; the intercept moves from the sample's odds to its odds.
    """
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, penalty = np.zeros(a.shape[1]), ridge * np.r_[np.ones(a.shape[1] - 1), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gram = sum((a[i : i + ROWS] * (p * (1 - p))[i : i + ROWS, None]).T @ a[i : i + ROWS] for i in range(0, len(a), ROWS))
        step = np.linalg.solve(gram + np.diag(penalty) + 1e-9 * np.eye(len(w)), a.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    if share is not None:
        w[-1] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return mean, scale, w


def apply_logistic(x: np.ndarray, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(((x - mean) / scale) @ w[:-1] + w[-1], -30, 30)))


def likelihood_ratio(a: Column, b: Column, n1: int, n0: int) -> Column:
    """2 ln of how much likelier a of n1 and b of n0 are with a share for each than with one share."""
    log = lambda k, n, p: F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n - k > 0, (n - k) * F.log(1 - p)).otherwise(0.0)
    one, zero = F.lit(float(n1)), F.lit(float(n0))
    p = (a + b) / (one + zero)
    return F.when(a / one > b / zero, 2 * (log(a, one, a / one) + log(b, zero, b / zero) - log(a, one, p) - log(b, zero, p))).otherwise(0.0)


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC, ordinary_rows: int = ORDINARY):
    """(ordinary dictionary, toxic dictionary, calibration) or, without both classes, the share of toxic rows."""
    known = labels.filter(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(C.remainder("doc_id", 5) != 0)
    # Rows without their texts meet the labels; only the sample's texts are fetched, by its hashes.
    hashed = C.of_documents(docs, "doc_id", "text").withColumn("hash", F.xxhash64("doc_id", "text"))
    rows = C.keep(hashed.select("doc_id", "hash", F.octet_length("text").cast("long").alias("bytes")).join(known, "doc_id"), "labelled-rows")
    size = {r[0]: r[1:] for r in rows.groupBy("toxic").agg(F.count("*"), F.sum("bytes")).collect()}
    if len(size) < 2:
        return float(size.get(1, (0,))[0]) / max(1, sum(n for n, _ in size.values()))
    part = {c: min(1.0, most / size[c][0], BYTES / max(1, size[c][1])) for c, most in ((1, toxic_rows), (0, ordinary_rows))}
    within = F.when(F.col("toxic") == 1, F.lit(part[1])).otherwise(F.lit(part[0]))
    drawn = rows.filter(F.col("bytes") <= BYTES // 16).filter(F.pmod(F.xxhash64("hash"), F.lit(1 << 30)) < within * (1 << 30)).select("hash", "toxic").distinct()
    texts = hashed.join(F.broadcast(drawn), "hash").select("text", "toxic", (F.pmod("hash", F.lit(10)) < SHARE).alias("fit"))  # about toxic_rows + ordinary_rows hashes
    texts = C.keep(texts, "labelled")
    n = {(r[0], r[1]): r[2] for r in texts.groupBy("toxic", "fit").count().collect()}
    alone = all((c, f) in n for c in (0, 1) for f in (True, False))  # else too few rows: all of them serve both
    fit, rest = (texts.filter("fit"), texts.filter("not fit")) if alone else (texts, texts)
    n1, n0 = (n.get((c, True), 0) + (0 if alone else n.get((c, False), 0)) for c in (1, 0))
    if not n1 or not n0:
        return size[1][0] / (size[1][0] + size[0][0])
    terms = C.map_batches(fit, _terms, "term binary, toxic long, ordinary long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    often = (F.col("toxic") + 0.5) / (n1 + 1) > RATIO * (F.col("ordinary") + 0.5) / (n0 + 1)
    strong = terms.filter("toxic >= 3").filter(often).filter(likelihood_ratio(F.col("toxic"), F.col("ordinary"), n1, n0) >= STANDS_OUT).select("term").collect()  # of at most BYTES of text
    pieces = C.map_batches(fit.filter("toxic = 1"), _pieces(frozenset(bytes(r[0]) for r in strong)), "sample binary")

    def samples(df: DataFrame) -> list[bytes]:  # at most BYTES of text
        """In a fixed mixed order: the trainer picks from stretches of its input, which copies side by side would fill."""
        got = sorted(bytes(r[0]) for r in df.collect())
        return [got[i] for i in np.random.default_rng(1).permutation(len(got))]

    toxic = dictionary(samples(pieces), TOXIC_BYTES, k=64, d=6)
    ordinary = dictionary(samples(C.map_batches(fit.filter("toxic = 0"), _windows, "sample binary")), ORDINARY_BYTES)
    got = C.map_batches(rest, _features(ordinary, toxic), "toxic int, x array<double>").orderBy("toxic", "x").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)
    return ordinary, toxic, fit_logistic(x, y, share=size[1][0] / (size[1][0] + size[0][0]))


def _score(model):
    def run(batches):
        for b in batches:
            if isinstance(model, float | int):
                p = np.full(b.num_rows, float(model))
            else:
                ordinary, toxic, calibration = model
                p = apply_logistic(np.array([features(t, ordinary, toxic) for t in b.column("text").to_pylist()]).reshape(b.num_rows, -1), calibration)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, **parameters) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = train(docs, labels, **parameters)
    kind = dict(docs.dtypes)["doc_id"]
    rows = C.of_documents(docs, "doc_id", "text").withColumn("held_out", C.remainder("doc_id", 5) == 0)
    return C.map_batches(rows, _score(model), f"doc_id {kind}, held_out boolean, score double, predicted int")
