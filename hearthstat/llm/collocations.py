"""Collocations of two to four words in each language, by SON partitioning.

Documents are dealt to ``SHARDS`` shards by a hash of their id.  A phrase that occurs ``support`` times in all occurs at
least ``ceil(support / SHARDS)`` times in some shard, so each shard is mined completely at that lowered support, level by
level: phrases of n words are counted only where both of their parts of n - 1 words are frequent in the shard.  What is
frequent in some shard is a candidate; a last pass counts all candidates in all documents, by their bytes.

Mining may name too many phrases but never too few, so it works on 64-bit hashes and on bitmaps of fixed size in place of
sets; the last pass does not: its counts, and so all results, are exact.  A word's language is part of its hash.

Scale: the number of shards is fixed and each is mined by all tasks (a shard of one task each would lower the support to
one as soon as there are 30).  Tasks add up equal phrases of some 2 million words before they send them; what is sent is
(hash, count).  A bitmap of 2^``BITS`` bits (4 MB) is all that is broadcast, whatever the input; if frequent phrases come to
fill it, it lets more through to the exact counts and nothing is lost.  Scores join phrases to the table of counts; the
first ``most`` of a language are chosen in parts first.

Defined results: null text is empty; null lang is ``und``; a null id is an id like any other; repeated rows all count;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C
from .word_hashes import _BYTE, _MIX, SLICE, _powers

SHARDS = 6  # at most 8: a key's last three bits
SUPPORT, LONGEST = 30, 4
BITS = 25  # of a bitmap: the logarithm of its size
FLUSH = 2 << 20  # keys that a task holds before it adds them up
JOINED = 1 << 19  # words whose phrases are spelt out at once
SALTS = 64

#: 0 for bytes of words, 1 for white space between them, 2 for what ends a piece.
_KIND = np.array([2 if b in b".,;:!?\n\x0b\x0c\r" else 1 if b in b" \t" else 0 for b in range(256)], np.uint8)


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts; of each word its hash, piece, text, first byte and end."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, 8 * text.offset)
    raw = text.buffers()[2]
    raw = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    raw = np.frombuffer(raw.tobytes().translate(C.LOWER), np.uint8)
    cuts = np.zeros(len(raw) + 1, bool)
    cuts[offsets - offsets[0]] = True
    hashes, pieces, first, end = [], [], [], []
    at, piece = 0, 0
    while at < len(raw):
        stop = min(len(raw), at + SLICE)
        while stop < len(raw) and not (_KIND[raw[stop]] or cuts[stop]):  # a slice ends between words
            stop += 1
        part, cut = raw[at:stop], cuts[at : stop + 1]
        kind = _KIND[part]
        inside = kind == 0
        s = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | cut[:-1]))
        e = np.flatnonzero(inside & (np.r_[~inside[1:], True] | cut[1:])) + 1
        up, down = _powers(1 << max(16, len(part).bit_length()))
        sums = np.r_[np.uint64(0), np.cumsum(_BYTE[part] * up[: len(part)])]
        h = (sums[e] - sums[s]) * down[s]
        borders = piece + np.cumsum((kind == 2) | cut[:-1])
        hashes.append(_mix(h))
        pieces.append(borders[s])
        first.append(s + at)
        end.append(e + at)
        at, piece = stop, int(borders[-1])
    joined = [np.concatenate(x) if x else np.empty(0, t) for x, t in ((hashes, np.uint64), (pieces, np.int64), (first, np.int64), (end, np.int64))]
    return raw, joined[0], joined[1], np.searchsorted(offsets - offsets[0], joined[2], side="right") - 1, joined[2], joined[3]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def phrase_hashes(hashes: np.ndarray, pieces: np.ndarray, salt: np.ndarray, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length up to ``n``: hashes of the phrases that begin at each word, and whether they lie in one piece."""
    g = _mix(hashes ^ salt)
    out = [(g, np.ones(len(g), bool))]
    for k in range(1, n):
        m = max(0, len(hashes) - k)
        g = _mix(g[:m] * _MIX + hashes[k:])
        out.append((g, pieces[:m] == pieces[k:]))
    return out


def _salts(lang: pa.Array) -> np.ndarray:
    d = lang.dictionary_encode()
    seeds = np.array([xxhash.xxh64_intdigest(x.encode(), 13) for x in d.dictionary.to_pylist()], np.uint64)
    return seeds[d.indices.to_numpy(zero_copy_only=False)] if len(lang) else np.empty(0, np.uint64)


def _held(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _shard_bit(key: np.ndarray, bits: int) -> np.ndarray:
    return key >> np.uint64(67 - bits) << np.uint64(3) | key & np.uint64(7)


def _mine(n: int, frequent, bits: int):
    """(key, count) of the phrases of n words whose parts are frequent in their shard."""

    def run(batches):
        held, size = [], 0

        def out():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(keys), FLUSH // 8):
                yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + FLUSH // 8].view(np.int64)), pa.array(counts[i : i + FLUSH // 8])], ["key", "n"])

        bitmap = np.frombuffer(frequent.value, np.uint64) if frequent else None
        for b in batches:
            _, h, pieces, of, _, _ = words_of(b.column("text"))
            shard = b.column("shard").to_numpy().astype(np.uint64)[of]
            grams = phrase_hashes(h, pieces, _salts(b.column("lang"))[of], n)
            keyed = lambda g: g & ~np.uint64(7) | shard[: len(g)]
            key, good = keyed(grams[-1][0]), grams[-1][1]
            if n > 1:
                parts = _held(bitmap, _shard_bit(keyed(grams[-2][0]), bits))
                good = good & parts[: len(good)] & parts[1 : len(good) + 1]
            held.append(key[good])
            size += len(held[-1])
            if size > FLUSH:
                yield from out()
                held, size = [], 0
        if size:
            yield from out()

    return run


def _bitmap(held: DataFrame, bits: int) -> bytes:
    """The bits (column ``bit``) as one map; what comes to the driver is 2^bits bits at most."""
    rows = held.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 AS int)))").alias("bits")).toArrow()
    out = np.zeros(1 << bits - 6, np.uint64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out.tobytes()


def candidates(docs: DataFrame, support: int, longest: int, bits: int) -> list[bytes]:
    """A bitmap for each length of what some shard finds frequent."""
    spark, least, found, frequent = docs.sparkSession, -(-support // SHARDS), [], None
    for n in range(1, longest + 1):
        counted = C.map_batches(docs, _mine(n, frequent, bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        keys = C.keep(counted.filter(F.col("n") >= least).select("key"), f"phrases-{n}")
        top = lambda b: F.shiftrightunsigned("key", 64 - b)
        found.append(_bitmap(keys.select(top(bits).alias("bit")), bits))
        if n < longest:
            frequent = spark.sparkContext.broadcast(_bitmap(keys.select((top(bits - 3) * 8 + F.col("key").bitwiseAND(7)).alias("bit")), bits))
    return found


def _count(longest: int, maps, bits: int):
    """(lang, phrase, size, count) of all candidates, and the number of words of each language as that of the empty phrase."""

    def run(batches):
        bitmaps = [np.frombuffer(m, np.uint64) for m in maps.value]
        for b in batches:
            raw, h, pieces, of, first, end = words_of(b.column("text"))
            if not len(h):
                continue
            inside = np.zeros(len(raw) + 1, np.int8)
            np.add.at(inside, first, 1)
            np.add.at(inside, end, -1)
            spelt = raw[np.cumsum(inside[:-1]).astype(bool)].tobytes()
            words = pa.LargeStringArray.from_buffers(len(h), pa.py_buffer(np.r_[0, np.cumsum(end - first)].astype(np.int64)), pa.py_buffer(spelt))
            d = b.column("lang").dictionary_encode()
            lang = d.indices.to_numpy(zero_copy_only=False)[of]
            codes, totals = np.unique(lang, return_counts=True)
            yield _rows(d.dictionary, codes, pa.array([""] * len(codes), pa.large_string()), 0, totals)
            for k, (g, one) in enumerate(phrase_hashes(h, pieces, _salts(b.column("lang"))[of], longest)):
                at = np.flatnonzero(one & _held(bitmaps[k], g >> np.uint64(64 - bits)))
                for i in range(0, len(at), JOINED):
                    some = at[i : i + JOINED]
                    parts = [words.take(pa.array(some + j)) for j in range(k + 1)]
                    phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if k else parts[0]
                    t = pa.table({"lang": lang[some], "phrase": phrase}).group_by(["lang", "phrase"], use_threads=False).aggregate([([], "count_all")])
                    t = t.combine_chunks()
                    yield _rows(d.dictionary, t["lang"].to_numpy(), t["phrase"].combine_chunks(), k + 1, t["count_all"].to_numpy())

    return run


def _rows(langs: pa.Array, codes: np.ndarray, phrases: pa.Array, size: int, counts: np.ndarray) -> pa.RecordBatch:
    phrases = phrases.combine_chunks() if isinstance(phrases, pa.ChunkedArray) else phrases
    cols = [langs.take(pa.array(codes)), phrases.cast(pa.string()), pa.array(np.full(len(codes), size, np.int32)), pa.array(np.asarray(counts, np.int64))]
    return pa.RecordBatch.from_arrays(cols, ["lang", "phrase", "size", "f"])


def phrase_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, bits: int = BITS) -> DataFrame:
    """lang, phrase, size, f: exact counts of all phrases of up to ``longest`` words that occur ``support`` times, and of
    the words of each language (size 0, the empty phrase); written as a table."""
    lang = F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang")
    rows = C.of_documents(docs.select("text", lang, F.pmod(F.xxhash64("doc_id"), SHARDS).cast("int").alias("shard")), "lang", "shard", "text")
    maps = docs.sparkSession.sparkContext.broadcast(candidates(rows, support, longest, bits))
    counted = C.map_batches(rows.select("lang", "text"), _count(longest, maps, bits), "lang string, phrase string, size int, f long")
    return C.keep(counted.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).filter((F.col("f") >= support) | (F.col("size") == 0)), "phrase-counts")


def _part(words, start, length):
    return F.array_join(F.slice(words, start, length), " ")


def mine(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, most: int = 2000, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``most`` best phrases of each language."""
    counts = phrase_counts(docs, support, longest, bits)
    phrases = counts.filter("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))
    parts = counts.filter(F.col("size").between(1, longest - 1))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    side = lambda on, name: parts.select("lang", F.col("phrase").alias(on), F.col("f").alias(name))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("cast((2000000BD * cast(a AS decimal(20, 0))) div (cast(l AS decimal(20, 0)) + cast(r AS decimal(20, 0))) AS long)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    pieces = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _part("w", i, n))))
    inner = phrases.filter("size >= 3").select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(pieces)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c, by: F.col(c).cast("decimal(20, 0)") * by
    left = best.join(inner, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (wide("longer", 100) < wide("a", 80)))
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"), F.pmod(F.xxhash64("phrase"), SALTS).alias("salt"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= most)
    top = first(first(left, "lang", "salt").drop("rank"), "lang")
    totals = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_SIZES = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM w, range(1, len(w) - {n - 2}) AS t(i)" for n in range(1, LONGEST + 1))
_CUTS = " UNION ALL ".join(f"SELECT lang, phrase, size, f AS a, {k} AS k, array_to_string(w[1:{k}], ' ') AS lp, array_to_string(w[{k + 1}:], ' ') AS rp FROM c WHERE size > {k}" for k in range(1, LONGEST))
_INNER = " UNION ALL ".join(
    f"SELECT lang, array_to_string(w[{i}:{i + n - 1}], ' ') AS phrase, f FROM c WHERE size > {n} AND size >= {i + n - 1}" for n in range(2, LONGEST) for i in range(1, LONGEST - n + 2)
)
SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS p FROM t)),
g AS (SELECT lang, size, phrase, count(*) AS f FROM ({_SIZES}) GROUP BY ALL HAVING count(*) >= {SUPPORT}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM g WHERE size >= 2),
s AS (SELECT u.lang, u.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM ({_CUTS}) u JOIN g l ON l.lang = u.lang AND l.phrase = lp JOIN g r ON r.lang = u.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(f) AS longer FROM ({_INNER}) GROUP BY 1, 2),
k AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "binary") AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
