"""Filter interaction audit by truth-table survival words.

Which of five filters a document fails is a mask of five bits; which of the 32 subsets of filters it would survive is a
word of 32 bits: bit S is set where the mask and S share no bit.  Adding up the words by bit position (carry-save: three
words become a sum word and a carry word of twice the weight, so most work is whole-array logic) gives the survivors of
every subset for each part and label.  Every figure of every order of the filters is a difference of such counts: what a
step removes is survivors(before) - survivors(before and itself), and so on; no order is run over documents.

Scale: one pass over texts leaves a row of id, part, mask and digest; texts are never shuffled.  Digests that occur more
than once and the labels are written as plain tables first, so that adaptive execution splits a hot digest or id.  Tasks
send 32 counts a part and label, and a part has 32 rows in the end.

Defined results: null text is empty, null lang the empty part; a row of a null id is no copy of any row, nor any row of
it; repeated rows of one id are not copies of each other; several labels of an id count as any of them; other columns are
ignored; an empty table gives no rows.  Equal SHA-256 digests stand for equal texts.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: The survival word of each failure mask.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & mask) for mask in range(SUBSETS)], np.uint32)
PARTS = 4096  # parts and labels whose counts a task holds before it sends them on


def failures(text: Column) -> Column:
    """Bits 0 to 3: under 100 words, under 80 % distinct words, over 10 % capitals, holds a marker."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = (n < 100, 100 * distinct < 80 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, label (1 for quality, 2 for toxic, added up) and the mask of failed filters of each document."""
    base = docs.select("doc_id", F.coalesce(docs["lang"].cast("string"), F.lit("")).alias("part"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    seen = C.keep(base.select("doc_id", "part", failures(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")), "features")
    firsts = C.keep(seen.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), "copies")
    yes = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = C.keep(labels.groupBy("doc_id").agg((yes("quality") + 2 * yes("toxic")).alias("label")).filter("label > 0"), "labels")
    copy = F.when(F.col("doc_id") > F.col("first"), SUBSETS >> 1).otherwise(0)
    marked = seen.join(firsts, "digest", "left").select("doc_id", "part", (F.col("mask") + copy).alias("mask"))
    return marked.join(known, "doc_id", "left").select("part", F.coalesce("label", F.lit(0)).alias("label"), "mask")


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of the 32-bit words have each bit set, by carry-save addition."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) > 2:
            k = len(words) // 3
            a, b, c = words[:k], words[k : 2 * k], words[2 * k : 3 * k]
            half = a ^ b
            carries.append(a & b | half & c)
            words = np.concatenate([half ^ c, words[3 * k :]])
        for w in words:
            counts += weight * (int(w) >> np.arange(32) & 1)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def _count(batches):
    """(part, label, survivors of each subset) of the task's documents."""
    held: dict[tuple[str, int], np.ndarray] = {}

    def out():
        keys = list(held)
        counts = pa.array([held[k].tolist() for k in keys], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), counts], ["part", "label", "counts"])

    for b in batches:
        part = b.column(0).dictionary_encode()
        key = part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + b.column(1).to_numpy()
        words = WORDS[b.column(2).to_numpy()]
        order = np.argsort(key, kind="stable")
        at = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(key) else []
        for i, group in zip(at, np.split(words[order], at[1:]), strict=False):
            k = key[order[i]]
            name = (part.dictionary[int(k >> 2)].as_py(), int(k & 3))
            held[name] = held.get(name, 0) + positional_popcount(group)
        if len(held) > PARTS:
            yield out()
            held.clear()
    yield out()


def survivors(rows: DataFrame) -> DataFrame:
    """part, subset, and how many documents survive it: all, with quality 1, toxic."""
    counted = rows.select("part", F.col("label").cast("int"), F.col("mask").cast("int")).mapInArrow(_count, "part string, label int, counts array<long>")
    one = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    of = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return one.groupBy("part", "subset").agg(F.sum("n").alias("all"), of(1).alias("good"), of(2).alias("toxic"))


#: (order, step, filter, subset before the step) of all orders.
STEPS = [("".join(o), k + 1, f, sum(1 << FILTERS.index(x) for x in o[:k])) for o in permutations(FILTERS) for k, f in enumerate(o)]
NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _figures(batches):
    """All steps of all orders of each part, from its 32 counts."""
    before = np.array([s[3] for s in STEPS])
    which = np.array([FILTERS.index(s[2]) for s in STEPS])
    bit = 1 << which
    full = SUBSETS - 1
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            n = np.zeros((3, SUBSETS), np.int64)
            for c in counts:
                n[:, c["subset"]] = c["all"], c["good"], c["toxic"]
            every = n[0]
            gone = n[:, before] - n[:, before | bit]
            value = [sum(factorial(m.bit_count()) * factorial(4 - m.bit_count()) * (every[m] - every[m | 1 << i]) for m in range(SUBSETS) if not m >> i & 1) for i in range(5)]
            figures = (every[before | bit], gone[0], every[0] - every[bit] - gone[0], every[full ^ bit] - every[full], gone[1], gone[2], np.array(value)[which])
            texts = [pa.array([part] * len(STEPS), pa.string()), pa.array([s[0] for s in STEPS]), pa.array([s[1] for s in STEPS], pa.int32())]
            yield pa.RecordBatch.from_arrays([*texts, *[pa.array(f, pa.int64()) for f in figures]], ["part", "filter_order", "step", *NAMES])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and its figures, for each part, all 120 orders and their five steps."""
    table = survivors(masks(docs, labels)).groupBy("part").agg(F.collect_list(F.struct("subset", "all", "good", "toxic")).alias("counts"))
    return table.mapInArrow(_figures, "part string, filter_order string, step int, " + ", ".join(f"{n} long" for n in NAMES))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (SELECT doc_id, part, CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT) + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INT) AS mask FROM d),
y AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM m LEFT JOIN y USING (doc_id) GROUP BY 1, 2),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, list_sum([CAST(0 AS BIGINT)] || [CAST(1 AS BIGINT) << (ord(x) - 65) FOR x IN string_split(filter_order[1:step - 1], '') IF x <> '']) AS before,
  CAST(1 AS BIGINT) << (ord(filter_order[step]) - 65) AS bit FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0) AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost
  FROM g, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""
