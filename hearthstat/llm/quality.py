"""Document quality by co-training two views.

The text view sees content: hashed pairs of bytes (square roots of their shares) and the variety of words.  The
page view sees what surrounds it: source, language, length and the layout of lines.  Each round, either view labels
the unlabelled documents it is surest of for the other; after the last, both are calibrated on labelled rows that
neither was fitted on, and a logistic combination of the calibrated views scores every document.

Scale: fitting uses at most ``LABELLED`` labelled and ``POOL`` unlabelled documents, chosen by a hash of the id;
their features (no texts) reach the driver.  Scoring is one scan; no text is shuffled.

Defined results: null texts are empty, null sources and languages are values of their own; conflicting labels of one
id count as low quality; repeated rows repeat; without both classes among the labels every document scores 1 (nothing
speaks against it); an empty table gives no rows; ``only_good`` passes other columns through untouched.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .toxicity import apply_logistic, fit_logistic

LABELLED, POOL = 8_000, 8_000
ROUNDS, SHARE = 4, 0.05  # of the pool that a view labels in a round
PAIRS = 256
THRESHOLD = 0.5
_KINDS = np.zeros(256, np.int64)  # kinds of bytes: letters, capitals, digits, spaces, ends of lines, signs, others
for _b in range(256):
    _KINDS[_b] = 1 if 65 <= _b <= 90 else 2 if 48 <= _b <= 57 else 3 if _b in (9, 32) else 4 if _b in (10, 13) else 0 if _b >= 128 or 97 <= _b <= 122 else 5


def text_view(text: str) -> np.ndarray:
    b = np.frombuffer(text.encode(), np.uint8)
    out = np.zeros(PAIRS + 8, np.float32)
    if not len(b):
        return out
    pairs = ((b[:-1].astype(np.uint32) * 0x9E37 + b[1:].astype(np.uint32) * 0x79B9) >> 5) & (PAIRS - 1)
    out[:PAIRS] = np.sqrt(np.bincount(pairs, minlength=PAIRS) / max(1, len(pairs)))
    out[PAIRS : PAIRS + 6] = np.sqrt(np.bincount(_KINDS[b], minlength=6) / len(b))
    words = text.split()
    out[PAIRS + 6] = len(set(words)) / max(1, len(words)) ** 0.8
    out[PAIRS + 7] = np.log1p(len(b) / max(1, len(words)))
    return out


def page_view(text: str, source: str | None, lang: str | None) -> np.ndarray:
    out = np.zeros(38, np.float32)
    out[zlib.crc32((source or "\0").encode()) % 16] = 1
    out[16 + zlib.crc32((lang or "\0").encode()) % 16] = 1
    lines = text.split("\n")
    sizes = np.fromiter(map(len, lines), np.float64, len(lines))
    out[32:] = np.log1p([len(text), len(lines), sizes.mean(), sizes.max(), sizes.min(), sizes.std()])
    return out


def _both(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    text, source, lang = (b.column(c).to_pylist() for c in ("text", "source", "lang"))
    text = [t or "" for t in text]
    views = [text_view(t) for t in text], [page_view(*r) for r in zip(text, source, lang, strict=True)]
    return np.array(views[0], np.float32).reshape(len(text), -1), np.array(views[1], np.float32).reshape(len(text), -1)


def _views(batches):
    for b in batches:
        x, z = _both(b)
        f = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), f(x), f(z)], ["doc_id", "y", "x", "z"])


def co_train(x: np.ndarray, z: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, share: float = SHARE):
    """Models of both views, their calibrations and the combination; y is -1 where there is no label."""
    known = np.flatnonzero(y >= 0)
    held, fit = known[::4], np.setdiff1d(known, known[::4])
    if len(np.unique(y[held])) < 2 or len(np.unique(y[fit])) < 2:
        held = fit = known
    pool = np.flatnonzero(y < 0)
    given = [dict(zip(fit.tolist(), y[fit].tolist(), strict=True)) for _ in range(2)]  # the labels each view has
    views = (x, z)
    base = y[fit].mean()
    learn = lambda v: fit_logistic(views[v][(k := list(given[v]))], np.array([given[v][i] for i in k]), 1.0)
    models = [learn(0), learn(1)]
    for _ in range(rounds if len(pool) else 0):
        for v in (0, 1):
            left = np.array([i for i in pool if i not in given[1 - v]], int)
            if not len(left):
                continue
            p = apply_logistic(views[v][left], models[v])
            n = max(1, int(share * len(pool)))
            low, high = np.argsort(p)[: max(1, round(n * (1 - base)))], np.argsort(p)[-max(1, round(n * base)) :]
            given[1 - v].update({int(left[i]): 0.0 for i in low if p[i] < 0.1})
            given[1 - v].update({int(left[i]): 1.0 for i in high if p[i] > 0.9})
        models = [learn(0), learn(1)]
    logit = lambda v, i: np.log(np.clip(p := apply_logistic(views[v][i], models[v]), 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6)))[:, None]
    calibrations = [fit_logistic(logit(v, held), y[held], 0.01) for v in (0, 1)]
    combined = fit_logistic(_combined(views[0][held], views[1][held], models, calibrations), y[held], 0.01)
    return models, calibrations, combined


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _combined(x, z, models, calibrations) -> np.ndarray:
    one = lambda v, a: _logit(apply_logistic(_logit(apply_logistic(a, models[v]))[:, None], calibrations[v]))
    return np.c_[one(0, x), one(1, z)]


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pool: int = POOL):
    """The model, or None without both classes of labels."""
    known = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("y"))
    ids = docs.select("doc_id").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.join(ids, "doc_id", "left_semi").orderBy(*order).limit(labelled)
    rest = ids.join(known, "doc_id", "left_anti").orderBy(*order).limit(pool).withColumn("y", F.lit(-1))
    picked = C.keep(chosen.union(rest), "chosen")  # at most labelled + pool ids
    texts = docs.select("doc_id", "text", "source", "lang").join(F.broadcast(picked), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    rows = C.map_batches(texts, _views, f"doc_id {kind}, y int, x binary, z binary").orderBy(*order).toArrow()
    y = rows.column("y").to_numpy().astype(float)
    if len(set(y[y >= 0])) < 2:
        return None
    x, z = (np.concatenate([np.frombuffer(v.as_buffer(), np.float32) for v in rows.column(c)]).reshape(len(y), -1) for c in "xz")
    del rows  # the driver holds the features once, as they came
    return co_train(x, z, y)


def _probability(b: pa.RecordBatch, model) -> np.ndarray:
    if model is None or not b.num_rows:
        return np.ones(b.num_rows)
    models, calibrations, combined = model
    return apply_logistic(_combined(*_both(b), models, calibrations), combined)


def _scored(model, threshold: float):
    def run(batches):
        for b in batches:
            p = _probability(b, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(p >= threshold)], ["doc_id", "score", "keep"])

    return run


def _filtered(model, threshold: float):
    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_probability(b, model) >= threshold))

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """doc_id, score (probability of good quality), keep for every row."""
    model = train(docs, labels, **parameters)
    kind = dict(docs.dtypes)["doc_id"]
    return C.map_batches(docs.select("doc_id", "text", "source", "lang"), _scored(model, threshold), f"doc_id {kind}, score double, keep boolean")


def only_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **parameters) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``."""
    model = train(docs, labels, **parameters)
    return C.map_batches(docs, _filtered(model, threshold), docs.schema)
