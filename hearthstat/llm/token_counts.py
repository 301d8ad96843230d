"""Token counts with a digest cache.

``count_tokens`` joins (digest of the normalised content, tokenizer version) to a stored table of counts, encodes
each distinct text that the table lacks once, appends those counts to the table and joins all documents to it.

Normalised content: the text as the tokenizer sees it; a null text is the empty text.  The tokenizer of
``byte_bpe_50k.json`` changes nothing before it splits, so nothing else may be normalised without changing counts.
Digest: SHA-256 of the UTF-8 bytes.  Tokenizer version: SHA-256 of the tokenizer file, so another file never
meets counts of this one.

Scale: one shuffle of texts (by digest, and copies are dropped before it), one of (digest, id) rows.  A group of
copies collapses to one row per map task before the shuffle.  The cache is plain Parquet: appends are
by Spark's committer, an append that is repeated after a failure gives equal rows, and readers take one row a key.

Defined results: null text counts as ''; empty text has 0 tokens; repeated rows give repeated rows; an empty
table gives no rows; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import hashlib
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .encoding import byte_level_counter

CACHE = "tokenizer_version string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def _encode(path: str):
    def run(batches):
        count = byte_level_counter(path)
        for b in batches:
            n = [count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return run


def stored(docs: DataFrame, cache_path: str, version: str) -> DataFrame:
    """The cache's counts of one tokenizer version, one row a digest; none if there is no table yet."""
    spark = docs.sparkSession
    try:
        rows = spark.read.schema(CACHE).parquet(cache_path)
    except Exception as e:  # the first run finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return rows.filter(F.col("tokenizer_version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; appends what was new to the table at ``cache_path``."""
    version = tokenizer_version(tokenizer_path)
    texts = C.of_documents(docs, "doc_id", "text").withColumn("digest", F.unhex(F.sha2("text", 256)))
    misses = (
        texts.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text")).join(stored(docs, cache_path, version), "digest", "left_anti")
    )
    new = C.map_batches(misses, _encode(tokenizer_path), "digest binary, n_tokens long")
    new.select(F.lit(version).alias("tokenizer_version"), "digest", "n_tokens").write.mode("append").parquet(cache_path)
    counts = C.keep(stored(docs, cache_path, version), "counts")  # a plain table: adaptive execution splits a digest of many copies only against one
    return (
        texts.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(counts, "digest")
        .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    )
