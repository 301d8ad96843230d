"""Token ids in wavelet matrices, one a shard.

A shard holds whole documents in ascending document order.  Its payload, little-endian throughout:

    "WVM1", uint8 planes, uint8 0, uint16 0, uint32 documents, uint64 tokens      header, 20 bytes
    int64 document id, uint32 tokens with the end id, uint32 0                    16 bytes a document
    then for each plane, highest bit first:
        uint64 zeros; ceil(tokens / 8) bytes of bits, first bit highest, padded to 8; uint32 ones before each
        512th bit (``ceil(tokens / 512) + 1`` of them)                            rank directory

A plane holds one bit of every id, in the order that stable partitions by the planes before it leave: a token costs
its bits and 6 % more, against 32 bits in a plain file, and access, rank, select and counts need only the planes.
``write_shards`` writes one shard a file (``maxRecordsPerFile``) in Parquet's envelope, so that Spark's committer
makes the files appear whole and once, in any store that Spark writes.

Scale: one range shuffle of texts by id; encoding and building run in tasks over streams of documents, with one
shard of ids in memory.  Only each range's total is added up in one place.

Defined results: a null text is empty and leaves only its end id; repeated rows are neighbours, in order of text;
a null id comes first; an empty table writes no shard; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C
from .encoding import word_encoder

SHARD = 1 << 21  # ids of a shard, but for a longer document
STEP = 512
NO_ID = -(1 << 63)  # stands for a null document id
SHARDS = "range int, shard int, n_tokens long, payload binary"


class WaveletMatrix:
    """Access, rank, select and counting on ids that may be read straight from a payload."""

    def __init__(self, n: int, planes: list[tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, width: int | None = None) -> WaveletMatrix:
        x = np.asarray(ids, np.uint32)
        width = width or max(1, int(x.max(initial=0)).bit_length())
        x = x.astype(np.uint16) if width <= 16 else x
        planes = []
        for bit in range(width - 1, -1, -1):
            b = ((x >> x.dtype.type(bit)) & x.dtype.type(1)).astype(np.bool_)
            packed = np.packbits(b)
            packed = np.r_[packed, np.zeros(-len(packed) % 8, np.uint8)]
            ones = np.add.reduceat(b, np.arange(0, len(b), STEP), dtype=np.uint32) if len(b) else np.empty(0, np.uint32)
            zero = np.flatnonzero(~b)
            planes.append((len(zero), packed, np.r_[np.uint32(0), np.cumsum(ones, dtype=np.uint32)]))
            x = np.concatenate([x[zero], x[np.flatnonzero(b)]])
        return cls(len(x), planes)

    def to_bytes(self) -> bytes:
        return b"".join(struct.pack("<Q", z) + bits.tobytes() + ranks.astype("<u4").tobytes() for z, bits, ranks in self.planes)

    @classmethod
    def from_bytes(cls, data: memoryview, n: int, width: int) -> WaveletMatrix:
        at, planes, size, marks = 0, [], -(-n // 8), -(-n // STEP) + 1
        size += -size % 8
        for _ in range(width):
            (zeros,) = struct.unpack_from("<Q", data, at)
            bits = np.frombuffer(data, np.uint8, size, at + 8)
            planes.append((zeros, bits, np.frombuffer(data, "<u4", marks, at + 8 + size)))
            at += 8 + size + 4 * marks
        return cls(n, planes)

    @staticmethod
    def _ones(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Ones before position i."""
        k = i // STEP
        part = bits[k * STEP // 8 : -(-i // 8)]
        return int(ranks[k]) + int(np.unpackbits(part, count=i - k * STEP).sum())

    @staticmethod
    def _find(bits: np.ndarray, ranks: np.ndarray, j: int, one: bool) -> int:
        """Position of the j-th (from 0) bit of this kind."""
        before = ranks if one else np.arange(len(ranks)) * STEP - ranks.astype(np.int64)
        k = int(np.searchsorted(before, j, side="right")) - 1
        part = np.unpackbits(bits[k * STEP // 8 : (k + 1) * STEP // 8]) == one
        return k * STEP + int(np.flatnonzero(part)[j - int(before[k])])

    def access(self, i: int) -> int:
        value = 0
        for zeros, bits, ranks in self.planes:
            one, b = self._ones(bits, ranks, i), bits[i >> 3] >> (7 - (i & 7)) & 1
            value, i = value << 1 | int(b), zeros + one if b else i - one
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """First position of the token after all planes, and the end of those before i."""
        if token >> len(self.planes):
            return 0, 0
        lo, hi = 0, i
        for k, (zeros, bits, ranks) in enumerate(self.planes):
            a, b = self._ones(bits, ranks, lo), self._ones(bits, ranks, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (len(self.planes) - 1 - k) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """Occurrences before position i."""
        lo, hi = self._range(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, j: int) -> int:
        """Position of the j-th occurrence, from 0."""
        lo, hi = self._range(token, self.n)
        if not 0 <= j < hi - lo:
            raise IndexError(f"{token} occurs {hi - lo} times")
        at = lo + j
        for k in range(len(self.planes) - 1, -1, -1):
            zeros, bits, ranks = self.planes[k]
            one = bool(token >> (len(self.planes) - 1 - k) & 1)
            at = self._find(bits, ranks, at - zeros if one else at, one)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, plane by plane from the last."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        v = np.zeros(self.n, kind)
        for bit, (zeros, bits, _) in enumerate(reversed(self.planes)):
            b = np.unpackbits(bits, count=self.n).view(np.bool_)
            out = np.empty_like(v)
            out[np.flatnonzero(~b)] = v[:zeros]
            out[np.flatnonzero(b)] = v[zeros:] | kind(1 << bit)
            v = out
        return v.astype(np.uint32)


def pack(doc_ids: list[int], lengths: list[int], ids: np.ndarray) -> bytes:
    w = WaveletMatrix.build(ids)
    docs = np.zeros(len(doc_ids), [("id", "<i8"), ("n", "<u4"), ("pad", "<u4")])
    docs["id"], docs["n"] = doc_ids, lengths
    return struct.pack("<4sBBHIQ", b"WVM1", len(w.planes), 0, 0, len(doc_ids), len(ids)) + docs.tobytes() + w.to_bytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Document ids, their token counts, the matrix."""
    magic, width, _, _, n_docs, n = struct.unpack_from("<4sBBHIQ", payload)
    if magic != b"WVM1":
        raise ValueError("not a shard of this format")
    docs = np.frombuffer(payload, [("id", "<i8"), ("n", "<u4"), ("pad", "<u4")], n_docs, 20)
    return docs["id"], docs["n"], WaveletMatrix.from_bytes(memoryview(payload)[20 + 16 * n_docs :], n, width)


def _shards(path: str, end_id: int, most: int):
    def run(batches):
        from pyspark import TaskContext

        encode, end = word_encoder(path), struct.pack("<I", end_id)
        here, shard, ids, docs, lengths, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def made():
            tokens = np.frombuffer(b"".join(ids), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([here], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(tokens)], pa.int64()), pa.array([pack(docs, lengths, tokens)], pa.binary())], ["range", "shard", "n_tokens", "payload"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                x = encode(text) + end
                if ids and held + len(x) // 4 > most:
                    yield made()
                    shard, ids, docs, lengths, held = shard + 1, [], [], [], 0
                ids.append(x)
                docs.append(NO_ID if doc_id is None else doc_id)
                lengths.append(len(x) // 4)
                held += len(x) // 4
        if ids:
            yield made()

    return run


def file_order(docs: DataFrame) -> DataFrame:
    """``docs``, read from Parquet files of one write, with ``place``: the order of its partitions and rows."""
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long")
    return docs.select("doc_id", "text", F.struct(part.alias("part"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))


def write_shards(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 2, shard_tokens: int = SHARD, by: str | None = None) -> None:
    """Encode every text, append ``end_id``, write the shards in ascending doc_id order or in that of the column ``by``."""
    rows = C.of_documents(docs, "doc_id", "text", *([by] if by else [])).withColumn("doc_id", F.col("doc_id").cast("long"))
    order = [F.col(by)] if by else [F.col("doc_id").asc_nulls_first(), F.col("text")]
    ordered = rows.repartitionByRange(by or "doc_id").sortWithinPartitions(*order).select("doc_id", "text")
    with C.bounded_batches(docs.sparkSession):
        C.map_batches(ordered, _shards(tokenizer_path, end_id, shard_tokens), SHARDS).write.option("maxRecordsPerFile", 1).parquet(path)


def _documents(batches):
    for b in batches:
        for here, shard, payload in zip(b.column("range").to_pylist(), b.column("shard").to_pylist(), b.column("payload").to_pylist(), strict=True):
            doc_ids, n, matrix = unpack(payload)
            ids = memoryview(matrix.decode().astype("<u4").tobytes())
            ends = np.cumsum(n, dtype=np.int64)
            crc = [zlib.crc32(ids[4 * (e - m) : 4 * e]) for e, m in zip(ends.tolist(), n.tolist(), strict=True)]
            k = len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([here] * k, pa.int32()), pa.array([shard] * k, pa.int32()), pa.array(doc_ids, mask=doc_ids == NO_ID), pa.array(ends - n, pa.int64()), pa.array(n.astype(np.int64)), pa.array(crc, pa.int64())],
                ["range", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
            )


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    shards = spark.read.schema(SHARDS).parquet(path)
    read = shards.mapInArrow(_documents, "range int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    rows = C.keep(read, "tokens", batch_rows=2)  # two shards at a time in a worker
    sizes = shards.select("range", "shard", "n_tokens")
    # One row a range of ids, so as many as the shuffle has partitions, then the shards of each range.
    ranges = sizes.groupBy("range").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("range")) - F.col("n"))
    before = F.sum("n_tokens").over(Window.partitionBy("range").orderBy("shard")) - F.col("n_tokens")
    base = sizes.withColumn("before", before).join(ranges.select("range", "base"), "range").select("range", "shard", (F.col("base") + F.col("before")).alias("base"))
    return rows.join(base, ["range", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def encode_corpus(docs: DataFrame, tokenizer_path: str, path: str, **parameters) -> DataFrame:
    write_shards(docs, tokenizer_path, path, **parameters)
    return read_shards(docs.sparkSession, path)
