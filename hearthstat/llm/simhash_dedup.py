"""SimHash near-duplicates by multi-index hashing.

``fingerprints``: for each text the 64-bit SimHash of its word shingles (A-Z lower-cased, words without ASCII
white space, repeats included; a text shorter than a shingle is one shingle; one without words has fingerprint 0).
Shingle hash: XXH64 with seed 42 of the space-joined words.  A bit is 1 if it is set in over half the hashes.

``near_duplicates``: components of fingerprints that differ in 4 bits or fewer.  Copies share a fingerprint and
are collapsed first; balls of radius 1 in each 32-bit segment are enumerated, equal keys fetched and whole
distances verified (see ``hamming``).  Texts are read once and never shuffled.

Defined results: null text is the empty text; empty texts share fingerprint 0 and are linked like any others;
repeated rows keep their number; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .hamming import components, links_within, multi_index_keys

BLOCK = 1 << 16  # shingles whose bits are counted at once


def simhash(text: str, k: int = 4) -> int:
    from xxhash import xxh64_digest

    words = text.encode().translate(C.LOWER).split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= k:
        return int.from_bytes(xxh64_digest(joined, 42), "big")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.r_[0, ends[: n - k] + 1]
    total, most = np.zeros(64, np.int64), n - k + 1
    for i in range(0, most, BLOCK):
        spans = zip(starts[i : i + BLOCK].tolist(), ends[k - 1 + i : k - 1 + i + BLOCK].tolist(), strict=False)
        hashes = b"".join([xxh64_digest(joined[s:e], 42) for s, e in spans])
        total += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > most).tobytes(), "big")


def of_hashes(hashes: np.ndarray) -> int:
    """The SimHash of given 64-bit hashes; 0 for none."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), BLOCK):
        total += np.unpackbits(hashes[i : i + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def _fingerprint(k: int):
    def run(batches):
        for b in batches:
            fp = np.fromiter((simhash(t, k) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, k: int = 4) -> DataFrame:
    """doc_id, fp for every row."""
    kind = dict(docs.dtypes)["doc_id"]
    return C.map_batches(C.of_documents(docs, "doc_id", "text"), _fingerprint(k), f"doc_id {kind}, fp long")


def near_duplicates(docs: DataFrame, k: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every row; ``radius`` up to 4."""
    if not 0 <= radius <= 4:
        raise ValueError("two segments with balls of radius 1 find distances up to 4")
    rows = C.keep(fingerprints(docs, k), "fingerprints")
    words = C.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "words")
    linked = components(links_within(words.select("fp"), radius, multi_index_keys))
    # Plain tables, so that adaptive execution can split the join of a giant component.
    named = C.keep(words.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    first = C.keep(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "first")
    classes = C.keep(named.join(first, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, **parameters) -> DataFrame:
    """One row of each component: that of the smallest id, then of the smallest ``common.row_key``; a null id comes last.

    Rows are told apart by id and content, so texts with a null id or a shared id are rows of their own.
    """
    rows = docs.select(C.row_key(docs).alias("key"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    of = C.keep(near_duplicates(rows.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), **parameters).select(F.col("doc_id").alias("key"), "component_id"), "components")
    ids = rows.select("key", F.col("row.doc_id").alias("doc_id")).distinct()
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("key"))
    first = of.distinct().join(ids, "key").groupBy("component_id").agg(F.min(order).alias("m")).select(F.col("m.key").alias("key"))
    return rows.join(first, "key", "left_semi").dropDuplicates(["key"]).select("row.*")
