"""Benchmark decontamination by greedy string tiling.

Texts and items are word sequences (A-Z lower-cased, ASCII punctuation and white space between words).  Seeds, the
windows of ``min_match`` words that a document shares with an item, join the two; only pairs whose seeds could reach
the threshold are tiled.  Tiling marks, from long to short, the longest matches that no earlier tile covers: windows
of the current length are found by Karp-Rabin hashes, compared word by word, and extended.  Tiles may stand in any
order, so reordered passages count in full.  Coverage is the part of the item's words under tiles; at ``threshold``
the pair is a leak.

Scale: documents are scanned where they lie and are never shuffled or joined with each other.  The benchmark is the
query set: it is cut into blocks of ``BLOCK_BYTES`` by a hash of the item; each block is sent to the tasks of one scan,
whose pairs are written once.  Every item that shares a seed is tried; nothing is capped, and the work on a pair does not
grow with the square of repeated words (see ``tiles``).

Defined results: null and empty texts and items match nothing; an item shorter than ``min_match`` is matched whole;
repeated rows give repeated pairs; empty tables give no pairs; other columns are ignored by ``leaks`` and passed through
by ``without_leaks``, which decides row by row, so that null ids and texts that share an id stay apart.
"""

from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK_BYTES = 32 << 20
#: A-Z to a-z, ASCII punctuation and control characters to spaces.
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_PLAIN).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of n words."""
    x = ids.astype(np.uint64) + np.uint64(1)
    h = np.zeros(max(0, len(x) - n + 1), np.uint64)
    for i in range(n):
        h = h * _MULTIPLIER + x[i : i + len(h)]
    return h


def _prefixes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and powers that give the Karp-Rabin hash of any window: h = sums[i + n] - sums[i] * powers[n]."""
    powers = np.full(len(ids) + 1, _MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(len(ids) + 1, pow(int(_MULTIPLIER), -1, 1 << 64), np.uint64)
    inverse[0] = 1
    scaled = np.r_[np.uint64(0), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(inverse)[:-1])]
    return scaled * powers, powers


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(start in item, start in doc, words): greedy string tiling of two id sequences; ids below 0 never match.

    The longest match of free words is found by bisection: windows of a length match if their hashes meet.  All tiles of
    that length are marked, in order of item and document, then the next length follows.  A length costs
    (n + m) log (n + m), and as tiles do not overlap there are at most sqrt(2 n) lengths, however often words repeat.
    """
    free = [item >= 0, doc >= 0]
    texts, hashed = (item, doc), (_prefixes(item), _prefixes(doc))
    out: list[tuple[int, int, int]] = []

    def windows(side: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of free windows of n words, and their hashes."""
        sums, powers = hashed[side]
        at = np.flatnonzero(run[side][: max(0, len(texts[side]) - n + 1)] >= n)
        return at, sums[at + n] - sums[at] * powers[n]

    most = min(len(item), len(doc))
    while most >= min_match:
        run = [_free_run(f) for f in free]
        low, high = min_match - 1, min(most, int(run[0].max(initial=0)), int(run[1].max(initial=0)))
        while low < high:
            n = (low + high + 1) // 2
            if np.isin(windows(0, n)[1], windows(1, n)[1]).any():
                low = n
            else:
                high = n - 1
        if low < min_match:
            break
        places: dict[int, list[int]] = {}
        at, h = windows(1, low)
        mine, g = windows(0, low)
        both = np.isin(h, g)
        for j, x in zip(at[both].tolist(), h[both].tolist(), strict=True):
            places.setdefault(x, []).append(j)
        next_of = dict.fromkeys(places, 0)
        whole = lambda side, i: free[side][i] and free[side][i + low - 1]  # noqa: E731, B023  # no tile is shorter, so one inside takes an end too
        for i, x in zip(mine.tolist(), g.tolist(), strict=True):
            if x not in places or not whole(0, i):
                continue
            starts, k = places[x], next_of[x]
            while k < len(starts) and not whole(1, starts[k]):
                k += 1
            next_of[x] = k
            while k < len(starts) and not (whole(1, starts[k]) and (item[i : i + low] == doc[starts[k] : starts[k] + low]).all()):
                k += 1  # equal hashes of other words
            if k < len(starts):
                j = starts[k]
                free[0][i : i + low] = free[1][j : j + low] = False
                out.append((i, j, low))
        most = low - 1
    return out


def _free_run(free: np.ndarray) -> np.ndarray:
    """How many free words follow each position, itself included."""
    taken = np.flatnonzero(~free)
    at = np.searchsorted(taken, np.arange(len(free)))
    return np.r_[taken, len(free)][at] - np.arange(len(free))


class Items:
    """A block of the benchmark: its words' ids, its items and which of them hold a seed."""

    def __init__(self, rows: list[tuple], min_match: int):
        self.ids: dict[bytes, int] = {}
        self.items, self.least = [], min_match
        seeds, of = [], []
        for item_id, text in rows:
            x = np.array([self.ids.setdefault(w, len(self.ids)) for w in words_of(text)], np.int64)
            if not len(x):
                continue
            n = min(min_match, len(x))
            h = _rolling(x, n) ^ np.uint64(n)
            seeds.append(np.unique(h))
            of.append(np.full(len(seeds[-1]), len(self.items)))
            self.items.append((item_id, x, h))
        self.lengths = sorted({min(min_match, len(x)) for _, x, _ in self.items})
        every, of = np.concatenate([np.empty(0, np.uint64), *seeds]), np.concatenate([np.empty(0, np.int64), *of])
        order = np.argsort(every, kind="stable")
        self.seeds, self.of = every[order], of[order]

    def match(self, text: str, threshold: float) -> list[tuple]:
        """(item id, coverage, tiles) of the items that the text covers to the threshold."""
        words = words_of(text)
        doc = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        known = doc >= 0
        hit_at, hit = [], []
        for n in self.lengths:
            if len(doc) < n:
                continue
            whole = known[: len(doc) - n + 1].copy()
            for i in range(1, n):
                whole &= known[i : len(doc) - n + 1 + i]
            at = np.flatnonzero(whole)
            if not len(at):
                continue
            h = np.zeros(len(at), np.uint64)
            for i in range(n):
                h = h * _MULTIPLIER + (doc[at + i].astype(np.uint64) + np.uint64(1))
            h ^= np.uint64(n)
            lo = np.searchsorted(self.seeds, h, side="left")
            ok = self.seeds[np.minimum(lo, len(self.seeds) - 1)] == h
            hit_at.append(at[ok])
            hit.append(h[ok])
        if not hit or not sum(map(len, hit)):
            return []
        where, found = np.concatenate(hit_at), np.concatenate(hit)
        once = np.unique(found)
        lo, hi = np.searchsorted(self.seeds, once, side="left"), np.searchsorted(self.seeds, once, side="right")
        items = np.unique(np.concatenate([self.of[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]))
        out = []
        for k in items.tolist():
            item_id, x, own = self.items[k]
            n = min(self.least, len(x))
            starts = np.flatnonzero(np.isin(own, once))
            covered = np.zeros(len(x) + 1, np.int64)
            np.add.at(covered, starts, 1)
            np.add.at(covered, np.minimum(starts + n, len(x)), -1)
            if (np.cumsum(covered[:-1]) > 0).mean() < threshold:
                continue  # even all seeds together cover too little
            got = tiles(x, _islands(doc, np.unique(where[np.isin(found, own)]), n), n)
            share = sum(t[2] for t in got) / len(x)
            if share >= threshold:
                out.append((item_id, share, len(got)))
        return out


def _islands(doc: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The document's words under seeds, with a word that matches nothing between islands."""
    at = np.unique((starts[:, None] + np.arange(n)).ravel())
    gaps = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(doc[at], gaps, -1)


def _matches(block: Items, threshold: float):
    def run(batches):
        for b in batches:
            kinds = [b.schema.field("doc_id").type, item_kind(block), pa.float64(), pa.int32()]
            rows = [(d, *m) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for m in block.match(t, threshold)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles"])

    return run


def item_kind(block: Items) -> pa.DataType:
    return pa.string() if any(isinstance(i, str) for i, _, _ in block.items) else pa.int64()


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, threshold: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles of every pair at the threshold; ids are numbers or strings."""
    kind = {True: "string", False: "long"}
    as_id = lambda df, c: F.col(c).cast(kind[dict(df.dtypes)[c] == "string"]).alias(c)
    items = C.of_documents(benchmark, "item_id", "text").select(as_id(benchmark, "item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    texts = C.of_documents(docs, "doc_id", "text").select(as_id(docs, "doc_id"), "text")
    schema = f"doc_id {kind[dict(docs.dtypes)['doc_id'] == 'string']}, item_id {kind[dict(benchmark.dtypes)['item_id'] == 'string']}, coverage double, n_tiles int"
    parts = []
    for i in range(blocks):  # a query set in blocks: each is a bounded list and one scan
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == i).orderBy("item_id", "text").collect()
        part = C.map_batches(texts, _matches(Items([(r[0], r[1]) for r in rows], min_match), threshold), schema)
        parts.append(part if blocks == 1 else C.keep(part, "leaks"))
    return reduce(DataFrame.union, parts)


def without_leaks(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``docs`` without the rows whose text leaks an item; null and repeated ids, and columns of any name, stay apart."""
    rows = docs.select(C.row_key(docs).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = leaks(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), benchmark, **parameters)
    bad = C.keep(found.select(F.col("doc_id").alias("key")).distinct(), "leaking")
    side = F.broadcast(bad) if bad.count() <= 200_000 else bad  # 200,000 keys are 7 MB
    return rows.join(side, "key", "left_anti").select("row.*")
