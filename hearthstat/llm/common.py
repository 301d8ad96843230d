"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A-Z to a-z on UTF-8 bytes; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20  # of an Arrow batch of texts

#: Words of a text in Spark's and Python's regular expressions: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local session, whose tasks run on this machine, gets a temporary one where the setting is missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="hearthstat-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_root(spark)}/hearthstat/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lost executors cost no recomputation.

    Arrow batches of the write hold ``batch_rows`` rows at most; the session's own setting returns afterwards.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    with bounded_batches(spark, batch_rows):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint an iteration's table as files in the shared folder; they stay until the folder is cleared.

    With spark.cleaner.referenceTracking.cleanCheckpoints=true Spark removes them once nothing refers to them.
    """
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Within it, Arrow batches that carry texts to Python workers hold ``rows`` rows and ``BATCH_BYTES`` at most."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def of_documents(docs: DataFrame, *cols: str) -> DataFrame:
    """The named columns with a null text as the empty text; any other column of ``docs`` goes."""
    return docs.select(*[F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text") if c == "text" else docs[c] for c in cols])


def row_key(docs: DataFrame) -> Column:
    """Names a row by id and content; never null."""
    return F.md5(F.concat_ws("/", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))))


def remainder(doc_id: Column | str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def map_batches(df: DataFrame, f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``; ``f`` sees each batch in parts of ``BATCH_ROWS`` rows, whatever the session's batches are."""

    def run(batches):
        return f(b.slice(i, BATCH_ROWS) for b in batches for i in range(0, b.num_rows, BATCH_ROWS))

    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
