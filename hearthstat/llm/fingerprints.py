"""Document fingerprints: weighted SimHash with permuted block tables.

Terms are word 3-grams (A-Z lower-cased, words without ASCII white space; a shorter text is one term).  A term's
weight is 1 + ln(its repeats in the text); its XXH64 votes with that weight for or against each bit, and the sign
of the sum is the bit (0 on a tie).  A text without words has fingerprint 0.  Likeness: 1 - differing bits / 64.

``near_classes`` finds all fingerprints within ``radius`` bits through permuted block tables (six blocks, twenty
tables that keep three of them; see ``hamming``) and names each document's class by its smallest id.

``edited_pairs`` prepares the contract's edited text: the last floor(n/4) code points of a text replaced by the
first as many (or all) of the next document in ascending id, after the last the first.

Scale: texts are shuffled once, by ranges of ids; each range also gets the first document of the next range, which
is found by a small aggregate, so no window runs over all documents and no text is joined.  Bounds of ranges come
from a quantile sketch; only one id a range reaches the driver.

Defined results: null text is empty; a null id sorts first; repeated ids follow each other in order of text; a
single document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .hamming import components, links_within, permuted_block_keys

RANGE_BYTES, RANGES = 4 << 20, 4096  # text of a range of ids, and ranges, up to 16 GB; beyond, both grow by the root of the size
NULL_FIRST = -(1 << 63)


def weighted_simhash(text: str, k: int = 3) -> int:
    from xxhash import xxh64_digest

    words = text.encode().translate(C.LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        hashes, votes = np.frombuffer(xxh64_digest(joined), ">u8"), np.ones(1, np.float32)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.r_[0, ends[: n - k] + 1]
        spans = zip(starts.tolist(), ends[k - 1 :].tolist(), strict=True)
        hashes, times = np.unique(np.frombuffer(b"".join([xxh64_digest(joined[s:e]) for s, e in spans]), ">u8"), return_counts=True)
        votes = (1 + np.log(times)).astype(np.float32)
    total = np.zeros(64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += votes[i : i + (1 << 14)] @ bits.astype(np.float32)
    return int.from_bytes(np.packbits(2 * total > float(votes.sum(dtype=np.float64))).tobytes(), "big")


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _pairs(k: int):
    names = ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"]

    def run(batches):
        out: list[tuple] = []
        held = None  # (range, doc_id, text, fingerprint) that waits for the next text

        def add(row, following, fp):
            text = edited(row[2], following)
            out.append((row[1], len(row[2]), hashlib.sha256(text.encode()).hexdigest(), row[3], weighted_simhash(text, k), fp))

        def batch():
            cols = list(zip(*out, strict=True))
            words = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in cols[3:]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), *words], names)

        for b in batches:
            for where, doc_id, guest, text in zip(*(b.column(c).to_pylist() for c in ("range", "doc_id", "guest", "text")), strict=True):
                fp = weighted_simhash(text, k)
                if held and held[0] == where:
                    add(held, text, fp)
                held = None if guest else (where, doc_id, text, fp)
            if out:
                yield batch()
                out = []

    return run


def edited_pairs(docs: DataFrame, k: int = 3, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp for every row."""
    spark = docs.sparkSession
    rows = C.of_documents(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, size // range_bytes)
    parts = int(min(parts, (RANGES * parts) ** 0.5)) if parts > RANGES else parts  # 320,000 ranges of 300 MB for 100 TB
    bounds = np.array(sorted({int(x) for x in rows.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)} if parts > 1 else ()), np.int64)

    @F.pandas_udf("int")
    def of_range(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(bounds, ids.fillna(0).to_numpy(np.int64), side="right")), dtype="int32")

    where = rows.select("doc_id").withColumn("range", of_range("doc_id")).groupBy("range").agg(F.min_by("doc_id", F.coalesce("doc_id", F.lit(NULL_FIRST))).alias("head"))
    heads = where.orderBy("range").collect()  # one row a range
    guests = spark.createDataFrame([(r["head"], heads[i - 1]["range"]) for i, r in enumerate(heads)], "head long, of int")
    placed = rows.withColumn("range", of_range("doc_id")).join(F.broadcast(guests), rows["doc_id"].eqNullSafe(guests["head"]), "left")
    own, guest = F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("of").alias("range"), F.lit(True).alias("guest"))
    both = placed.select("doc_id", "text", F.explode(F.when(F.col("of").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("at"))
    ordered = both.select("doc_id", "text", "at.range", "at.guest").repartition(F.col("range")).sortWithinPartitions("range", "guest", F.col("doc_id").asc_nulls_first(), "text")
    return C.map_batches(ordered, _pairs(k), "doc_id long, n_chars long, edited_sha256 string, fp long, edited_fp long, next_fp long")


def likeness(a: str, b: str):
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def near_classes(fps: DataFrame, radius: int = 3) -> DataFrame:
    """``class_id`` beside ``doc_id`` and ``fp``: the smallest id that links within ``radius`` (up to 3) bits lead to."""
    words = C.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "words")
    linked = components(links_within(words.select("fp"), radius, permuted_block_keys))
    # Plain tables, so that adaptive execution can split the joins of a giant class and of a hot fingerprint.
    named = C.keep(words.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    first = C.keep(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "first")
    classes = C.keep(named.join(first, "root").select("fp", "class_id"), "classes")
    return fps.join(classes, "fp")


def fingerprint_documents(docs: DataFrame, radius: int = 3) -> DataFrame:
    rows = C.keep(edited_pairs(docs), "edited")
    word = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return near_classes(rows, radius).select(
        "doc_id", "n_chars", "edited_sha256", word("fp").alias("fingerprint"), word("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), "class_id",
    )
