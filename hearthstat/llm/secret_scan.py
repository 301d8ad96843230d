"""Secret scans: findings of rules, and a character network over every other candidate.

Rules find assignments, access keys and hexadecimal runs.  Every other run of twelve characters or more of a secret's
alphabet is a candidate; the network reads it whole, in windows, with what stands around it.  It is trained on labelled
findings of the corpus: the values that rules found are secrets, candidates that no rule touches are not (hexadecimal
runs of digits alone are left out: they are as often numbers of other kinds).  So that it learns the look of values and
not the rules' own words, findings also enter in other notations of the same bytes and contexts change places between
examples.  Scores are calibrated on rows that training did not see; the threshold of each shape of candidates (hexadecimal,
mixed, letters) is the highest that keeps ``RECALL`` of the findings among further rows.

Scale: two passes over texts, no shuffle of them.  All distinct examples of all documents, with how often each occurs, are
dealt by their hashes to shards of about ``SHARD`` windows; two of four parts train, one calibrates and one sets thresholds.
A step of training runs in one task a shard, from the mean of what all shards reached in the step before, and its steps
together pass over every window of a shard at least once.  Calibration and thresholds come from counts of all windows of their parts
by logit, in bins of 1/``BINS``, weighed by occurrences.  The driver gets one network a step and the counts, whatever the size.

Defined results: null text is empty; an empty text has no findings; repeated rows give repeated rows; a corpus without
findings of the rules has no network, and only the rules speak; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from . import char_net as N
from . import common as C

KINDS = ("assign", "access", "hex", "net")
SHARD = 40_000  # windows of either class that a task trains on
ROUNDS, STEPS = 8, 100  # of training: what shards reach is averaged after so many steps of 128 windows
BINS, MOST = 256, 30  # bins of a logit's unit, and the largest logit that is told apart
FIXED = 1 << 40  # of a unit: sums of whole numbers don't depend on their order
RECALL = 0.98
STRIDE = 32  # of windows over a long value
FINDINGS = ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long").add("score", "double"))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.-]{12,}={0,2}")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def rule_findings(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of what the rules find, in order.

    Runs of access keys and digits are greedy, so asking for their least length at once finds the same runs; assignments
    are matched first and measured then, for a short value hides what follows within it.
    """
    out = [(m.start(), 0, m.end(), m.start(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12] if "=" in text or ":" in text else []
    out += [(m.start(), 1, m.end(), m.start()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, found: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """Runs of a secret's alphabet that no finding touches, without stops and strokes at their ends."""
    out, k, ends = [], 0, 0
    for m in _CANDIDATE.finditer(text):
        while k < len(found) and found[k][0] < m.end():
            ends = max(ends, found[k][2])
            k += 1
        if ends > m.start():
            continue
        value = m[0].rstrip("._/-")
        start = m.end() - len(m[0]) + len(value) - len(value.lstrip("._/-"))
        end = m.start() + len(value)
        if end - start >= 12:
            out.append((start, end))
    return out


def shape(value: str) -> int:
    """0 for hexadecimal digits of one case or both, 2 for letters alone, 1 for the rest."""
    if re.fullmatch(r"[0-9a-fA-F]+", value):
        return 0
    return 2 if value.isalpha() else 1


def _digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), 11)


def _example(text: str, start: int, end: int) -> tuple[str, str, str]:
    """A window of the value with its surroundings; where it begins in a long value depends on the value."""
    room = max(0, end - start - N.VALUE)
    at = start + (_digest(text[start:end]) % (room + 1) if room else 0)
    return text[max(0, start - N.LEFT) : start], text[at : min(end, at + N.VALUE)], text[end : end + N.RIGHT]


def _examples(batches):
    """Every example of the texts."""
    for b in batches:
        rows = []
        for text in b.column("text").to_pylist():
            found = rule_findings(text)
            secret = [(s, e) for _, kind, e, s in found if kind < 2 or not text[s:e].isdigit()]
            for y, spans in ((1, secret), (0, candidates(text, found))):
                rows += [(y, *_example(text, s, e)) for s, e in spans]
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), *[pa.string()] * 3), strict=True)], ["y", "left", "value", "right"])


def _windows(batches):
    """Windows of examples as they are and in other notations; ``weight`` is six times an occurrence, dealt among the forms."""
    for b in batches:
        rows = []
        for y, a, v, e, n in zip(*(b.column(c).to_pylist() for c in ("y", "left", "value", "right", "n")), strict=True):
            forms = [v, *notations(v)] if y else [v, *([v.upper()] if v.islower() else [])]
            key = _digest(a, v, e)
            rows += [(y, shape(f), key % 4, (key >> 2) - (1 << 61), i, n * 6 // len(forms), N.packed(a, f, e)) for i, f in enumerate(forms)]
        types = {"y": pa.int32(), "shape": pa.int32(), "part": pa.int32(), "key": pa.int64(), "form": pa.int32(), "weight": pa.int64(), "ids": pa.binary()}
        cols = zip(*rows, strict=True) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types.values(), strict=True)], list(types))


def _shard(table: pa.Table, seed: int):
    """Windows, class, shape and weight of a shard's rows: as they are and in each other's places."""
    table = table.sort_by([("y", "ascending"), ("key", "ascending"), ("form", "ascending"), ("ids", "ascending")])
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.uint8).reshape(-1, N.LENGTH)
    y, k, w = (table.column(c).to_numpy() for c in ("y", "shape", "weight"))
    moved = ids[np.random.default_rng(seed).integers(len(ids), size=len(ids))]
    moved[:, N.LEFT : N.LEFT + N.VALUE] = ids[:, N.LEFT : N.LEFT + N.VALUE]
    return np.concatenate([ids, moved]), np.r_[y, y], np.r_[k, k], np.r_[w, w]


def _step(state: N.State, round: int, rounds: int, steps: int):
    """A shard's steps from ``state``; its outcome as whole numbers by place.  A shard without one of the classes gives nothing."""

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        ids, y, _, _ = _shard(table, shard)
        flat = N.flat(N.train(state, ids, y, round * steps, steps, rounds * steps, shard)) if 0 < y.sum() < len(y) else np.empty(0)
        return pa.table({"place": pa.array(np.arange(len(flat)), pa.int32()), "value": pa.array(np.round(flat * FIXED).astype(np.int64))})

    return run


def _counted(net: dict[str, np.ndarray]):
    """How many windows of a shard, and of what weight, have a class, a shape and a logit."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        ids, y, k, w = _shard(table, table.column("shard")[0].as_py())
        z = np.floor(np.clip(N.logits(net, ids), -MOST, MOST) * BINS).astype(np.int64)
        kinds, at = np.unique(np.stack([y, k, z]), axis=1, return_inverse=True)
        weight = np.zeros(kinds.shape[1], np.int64)
        np.add.at(weight, at.ravel(), w)
        cols = [np.full(kinds.shape[1], part), *kinds, np.bincount(at.ravel()), weight]
        return pa.table([pa.array(c.astype(np.int64)) for c in cols], ["part", "y", "shape", "z", "n", "weight"])

    return run


@dataclass
class Model:
    net: dict[str, np.ndarray]
    scale: float
    shift: float
    thresholds: np.ndarray  # of each shape

    def of_logits(self, z):
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        return self.of_logits(N.logits(self.net, ids))


def notations(value: str) -> list[str]:
    """The bytes of a hexadecimal value in other alphabets; none if it holds none."""
    if len(value) % 2 or not re.fullmatch(r"[0-9a-f]+", value):
        return []
    raw = bytes.fromhex(value)
    n, digits = int.from_bytes(raw), ""
    while n:
        n, d = divmod(n, 62)
        digits += _BASE62[d]
    return [base64.b64encode(raw).decode(), base64.urlsafe_b64encode(raw).decode().rstrip("="), base64.b32encode(raw).decode().rstrip("="), value.upper(), digits]


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Scale and shift of logits by Newton's method over weighted bins of ``n`` rows, with targets that are never quite 0 or 1."""
    ones, rows = n[y == 1].sum(), n.sum()
    t, w = np.where(y == 1, 1 - 1 / (ones + 2), 1 / (rows - ones + 2)), w * (rows / w.sum())
    c, x = np.array([1.0, 0.0]), np.c_[z, np.ones(len(z))]
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (w * q * (1 - q))[:, None]) + 1e-6 * np.eye(2), x.T @ (w * (q - t)))
        c = c - np.clip(step, -2, 2)
    return float(max(c[0], 1e-3)), float(c[1])


def _network(rows: DataFrame, rounds: int = ROUNDS, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Trained on all windows of ``rows``, a task a shard and step; the mean of the shards begins the next one."""
    state = N.State.begin(5)
    for i in range(rounds):
        sums = rows.groupBy("shard").applyInArrow(_step(state, i, rounds, steps), "place int, value long").groupBy("place").agg(F.sum("value").alias("sum"), F.count("*").alias("n"))
        got = sums.orderBy("place").toArrow()  # a number for each parameter and its two moments
        if got.num_rows:
            state = N.unflat(got.column("sum").to_numpy() / got.column("n").to_numpy() / FIXED)
    return state.net


def train(docs: DataFrame, shard: int = SHARD, recall: float = RECALL) -> Model | None:
    """The network, its calibration and thresholds; None where there is nothing to learn from."""
    rows = C.map_batches(C.of_documents(docs, "text"), _examples, "y int, left string, value string, right string")
    once = C.keep(rows.groupBy("y", "left", "value", "right").agg(F.count("*").alias("n")), "examples")
    n = {r[0]: r[1] for r in once.groupBy("y").count().collect()}
    if any(n.get(y, 0) < 16 for y in (0, 1)):
        return None
    windows = C.keep(C.map_batches(once, _windows, "y int, shape int, part int, key long, form int, weight long, ids binary"), "windows")
    size = {(r[0], r[1]): r[2] for r in windows.groupBy("part", "y").count().collect()}
    alone = all((p, y) in size for p in range(4) for y in (0, 1))  # else too few examples: all of them serve every part
    parts = [windows.filter(f) if alone else windows for f in ("part < 2", "part = 2", "part = 3")]
    in_part = [[sum(v for (p, c), v in size.items() if c == y and (not alone or p in own)) for y in (0, 1)] for own in ((0, 1), (2,), (3,))]
    # The larger class says how many shards there are; with the rows in others' places each counts twice.
    dealt = [p.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(1 + 2 * max(c) // shard)).cast("int")) for p, c in zip(parts, in_part, strict=True)]
    net = _network(dealt[0])
    named = [p.withColumn("part", F.lit(i)) for i, p in enumerate(dealt)]
    counts = named[1].union(named[2]).groupBy("part", "shard").applyInArrow(_counted(net), "part long, y long, shape long, z long, n long, weight long")
    counts = counts.groupBy("part", "y", "shape", "z").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight")).orderBy("part", "y", "shape", "z").toArrow()  # bins at most
    part, y, k, z, n, w = (counts.column(c).to_numpy() for c in ("part", "y", "shape", "z", "n", "weight"))
    one = part == 1
    model = Model(net, *_platt((z[one] + 0.5) / BINS, y[one], w[one].astype(float), n[one]), np.zeros(3))

    def level(own: np.ndarray) -> float:
        """The probability at the lower end of the bin down to which ``recall`` of the rows lie."""
        zs, order = z[own], np.argsort(z[own], kind="stable")
        at = np.searchsorted(np.cumsum(n[own][order]), int((1 - recall) * n[own].sum()), side="right")
        return model.of_logits(zs[order][at] / BINS)

    last = (part == 2) & (y == 1)
    model.thresholds = np.array([level(last & (k == s)) if n[last & (k == s)].sum() >= 20 else level(last) for s in range(3)], float)
    return model


def findings(texts: list[str], model: Model | None) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, score) of each text's findings, in order."""
    found, spans, ids = [], [], []
    for i, text in enumerate(texts):
        rules = rule_findings(text)
        found.append([(s, kind, e, 1.0) for s, kind, e, _ in rules])
        for s, e in candidates(text, rules) if model else ():
            starts = [*range(s, max(s, e - N.VALUE), STRIDE), max(s, e - N.VALUE)]
            left, right = text[max(0, s - N.LEFT) : s], text[e : e + N.RIGHT]
            ids += [N.packed(left, text[a : min(e, a + N.VALUE)], right) for a in starts]
            spans.append((i, s, e, shape(text[s:e]), len(starts)))
    if spans:
        best = np.maximum.reduceat(model.probabilities(N.unpacked(ids)), np.r_[0, np.cumsum([x[4] for x in spans])[:-1]])
        for (i, s, e, k, _), p in zip(spans, best.tolist(), strict=True):
            if p >= model.thresholds[k]:
                found[i].append((s, 3, e, p))
    return [sorted(f) for f in found]


def find_secrets(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id and findings (kind, start, end in code points, score; by start, then kind) of every row.

    Rules' findings have score 1, those of the network their probability.  Without ``model`` one is trained on ``docs``.
    """
    model = model or train(docs)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            rows = [[(KINDS[k], s, e, p) for s, k, e, p in f] for f in findings(b.column("text").to_pylist(), model)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end", "score"), f, strict=True)) for f in r] for r in rows], kind)], ["doc_id", "findings"])

    rows = C.of_documents(docs, "doc_id", "text")
    return C.map_batches(rows, run, rows.select("doc_id").schema.add("findings", FINDINGS))


def redacted(docs: DataFrame, model: Model | None = None, mark: str = "<secret>") -> DataFrame:
    """doc_id and text with every finding replaced; findings that overlap are replaced as one."""
    model = model or train(docs)

    def run(batches):
        for b in batches:
            texts, out = b.column("text").to_pylist(), []
            for text, found in zip(texts, findings(texts, model), strict=True):
                parts, at = [], 0
                for s, _, e, _ in found:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = C.of_documents(docs, "doc_id", "text")
    return C.map_batches(rows, run, rows.schema)


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the rules' findings, the digest of their places, and all places as text."""
    place = lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))
    joined = lambda a: F.array_join(F.transform(a, place), ",")
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rules = F.filter("findings", lambda f: f["kind"] != "net")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(rules), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
