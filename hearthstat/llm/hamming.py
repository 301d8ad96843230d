"""Links between 64-bit fingerprints within a Hamming radius, and connected components of links.

The input is one column ``fp`` (long) of distinct fingerprints.  A scheme turns each into bucket keys such that
two fingerprints within the radius share a key at least:

* ``multi_index_keys``: two 32-bit segments; two words within 4 bits are within 2 in one segment, and each emits
  all words within 1 of its own segment (33 keys a segment), so they meet;
* ``permuted_block_keys``: the words cut into blocks, one table for each choice of blocks to keep as the key;
  with ``radius`` more blocks than are kept, some table keeps only equal blocks.

Rows of a key are then verified on all 64 bits.  Keys with over ``DENSE`` rows are counted first, by partial
aggregation.  Rows of other keys meet in one task, run by run; a run gives a forest of verified links, not its
pairs.  Fingerprints in dense keys are linked exactly without pairs: each emits every word within half the radius
(its ball); words that share a centre are near each other by the triangle inequality, so a star per centre is
enough, and its minimum is pre-aggregated.  Both ways together find every link's component at a cost in proportion
to the number of fingerprints, however dense their groups.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DENSE = 1024  # rows of a key that one task compares


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(bits: range, most: int) -> list[int]:
    """Words with up to ``most`` of these bits set, the empty one first."""
    return [_signed(sum(1 << b for b in c)) for n in range(most + 1) for c in combinations(bits, n)]


def multi_index_keys(fp: Column) -> list[Column]:
    """Keys for radius 4: the ball of radius 1 in either half, told apart by the half's number."""
    low = F.lit((1 << 32) - 1)
    halves = (F.shiftrightunsigned(fp, 32), fp.bitwiseAND(low))
    return [F.xxhash64(F.lit(i), half.bitwiseXOR(F.lit(m))) for i, half in enumerate(halves) for m in _masks(range(32), 1)]


def permuted_block_keys(fp: Column, blocks: int = 6, radius: int = 3) -> list[Column]:
    """One key for each choice of ``blocks - radius`` blocks of the word."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    out = []
    for i, kept in enumerate(combinations(range(blocks), blocks - radius)):
        mask = _signed(sum(((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in kept))
        out.append(F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(mask))))
    return out


def _forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each word of a run the smallest position that links lead to."""
    n, label = len(fp), np.arange(len(fp))
    near = [np.nonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= radius)[0] + i + 1 for i in range(n - 1)]
    a = np.repeat(np.arange(n - 1), [len(x) for x in near]) if n > 1 else np.empty(0, int)
    b = np.concatenate(near) if n > 1 else a
    while len(a):
        m = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (label == before).all():
            break
    return label


def _verify(radius: int):
    def links(key: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
        """(fp, fp of its run's root) for rows sorted by key."""
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[start, len(key)])
        out = []
        two = start[size == 2]
        ok = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
        out.append(np.stack([fp[ok + 1], fp[ok]]))
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            run = fp[s : s + n]
            label = _forest(run, radius)
            at = np.flatnonzero(label != np.arange(n))
            if len(at):
                out.append(np.stack([run[at], run[label[at]]]))
        return out

    def run(batches):
        held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def rows(parts):
            a = np.concatenate(parts, axis=1) if parts else np.empty((2, 0), np.uint64)
            a = np.unique(a, axis=1) if a.shape[1] else a
            return pa.RecordBatch.from_arrays([pa.array(a[0].view(np.int64)), pa.array(a[1].view(np.int64))], ["a", "b"])

        for b in batches:
            key = np.concatenate([held_key, b.column("key").to_numpy()])
            fp = np.concatenate([held_fp, b.column("fp").to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))  # the last run may go on in the next batch
            held_key, held_fp = key[last:], fp[last:]
            if last:
                yield rows(links(key[:last], fp[:last]))
        if len(held_key):
            yield rows(links(held_key, held_fp))

    return run


def links_within(fps: DataFrame, radius: int, scheme, dense: int = DENSE) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints whose components are those of all pairs within ``radius``."""
    fp = F.col("fp")
    keys = fps.select("fp", F.explode(F.array(*scheme(fp))).alias("key"))
    crowded = C.keep(keys.groupBy("key").count().filter(F.col("count") > dense).select("key"), "crowded")
    n = crowded.count()
    side = F.broadcast(crowded) if n <= 200_000 else crowded  # 200,000 longs are 3 MB
    rest = keys.join(side, "key", "left_anti") if n else keys
    near = rest.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_verify(radius), "a long, b long").distinct()
    if not n:
        return near
    half, more = radius // 2, radius - radius // 2
    words = keys.join(side, "key", "left_semi").select("fp").distinct()
    ball = lambda r: F.array(*[F.lit(m) for m in _masks(range(64), r)])
    close = len(_masks(range(64), half))  # masks come by size, so the first ones reach the words within the smaller radius
    stars = (
        words.select("fp", F.posexplode(ball(more)).alias("i", "mask")).select("fp", (F.col("i") < close).alias("close"), fp.bitwiseXOR(F.col("mask")).alias("centre"))
    )
    hub = stars.groupBy("centre").agg(F.min(F.when(F.col("close"), fp)).alias("hub"), F.count("*").alias("n")).filter((F.col("n") > 1) & F.col("hub").isNotNull())
    joined = stars.join(hub.select("centre", "hub"), "centre").filter(fp != F.col("hub")).select(fp.alias("a"), F.col("hub").alias("b"))
    return near.union(joined.distinct())


def components(links: DataFrame, most: int = 60, rows: int | None = None) -> DataFrame:
    """``node``, ``root``: the smallest node that links lead to, for every node of ``links`` (a, b) but the roots.

    Alternating large and small stars; each round is checkpointed.  Only two numbers a round come to the driver.
    With ``rows``, a round's edges are kept in as many partitions as hold about so many each: edges never grow in number.
    """
    a, b = F.col("a"), F.col("b")
    edges = C.cut(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(a != b).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(edges)
    if not before[0]:
        return edges.select(a.alias("node"), b.alias("root"))
    for _ in range(most):
        both = edges.union(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter(b > a).select(b.alias("a"), F.col("m").alias("b")).filter(a != b).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter(b != F.col("m")).select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        after = small.union(least.select("a", F.col("m").alias("b"))).distinct()
        edges = C.cut(after.coalesce(1 + before[0] // rows) if rows else after)
        after = state(edges)
        if after == before:
            return edges.select(a.alias("node"), b.alias("root"))
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")
