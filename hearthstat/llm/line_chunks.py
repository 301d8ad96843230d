"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A text's lines are hashed (the first 32 bits of MD5); a rolling hash over a line's hash and the next one's begins a chunk
at the line unless ``divisor`` divides it, so a boundary depends on two lines alone and returns after an insertion.  A
chunk has two lines at least and ends before the next boundary, or after ``LONGEST`` lines.  Where a repeated passage
begins or ends within chunks, only a part of them is repeated: so a chunk also counts by its beginnings (two lines or
more, up to the next boundary's line), and the lines before a boundary with the boundary's two.  What occurs again
anywhere in the corpus is removed but for its first occurrence (smallest doc_id, then text's MD5, then position): a
repeated run of lines goes whole if it holds a boundary with its two lines, and of every line one copy stays somewhere.
Equal hashes only nominate: chunks are then grouped by their bytes.

Scale: hashes of chunks are counted with partial aggregation, so the rows of a chunk that stands in a third of all
documents shrink before the shuffle; only nominated chunks carry text, and a chunk's text meets its copies through
partial aggregation as well.  Copies of a row are one row with a count.  Removals return to documents as positions, and a
document's work is in proportion to its lines and removals (sets and places in arrays, no searches or slices).

Defined results: null text stays null and counts no line; an empty text is one empty line; repeated rows are
documents of their own: the first is treated like any document, the others lose every repeated chunk; a null id comes
first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DIVISOR = 8  # seven of eight pairs of neighbouring lines begin a chunk: most texts have few lines
LONGEST = 8  # lines of a chunk


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def held(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once a row: a generator keeps them from being copied into later lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def span(first: Column, last: Column) -> Column:
    """First line number and length less one in one long; Spark's sets hash the halves' XOR, which differs between these."""
    return F.shiftleft(first.cast("long"), 32).bitwiseOR((last - first).cast("long"))


def first_of(s: Column) -> Column:
    return F.shiftright(s, 32).cast("int")


def last_of(s: Column) -> Column:
    return first_of(s) + s.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def with_chunks(df: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """``spans`` beside ``lines``: each chunk's beginnings, and the lines before each boundary with the boundary's two."""
    none, size = F.array().cast("array<int>"), F.size("lines")
    df = held(df, hashes=F.transform("lines", line_hash))
    rolled = F.zip_with(F.slice("hashes", 1, F.greatest(size - 1, F.lit(0))), F.slice("hashes", 2, F.greatest(size - 1, F.lit(0))), lambda a, b: (a * 31 + b) % divisor)
    df = held(df, rolled=rolled)
    df = held(df, cut=F.filter(F.transform("rolled", lambda r, i: F.when((r != 0) | (i == 0), i)), lambda i: i.isNotNull()))
    after = lambda c, n: F.concat(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), F.array(n))
    long = F.flatten(F.zip_with("cut", after("cut", size), lambda a, b: F.sequence(a, b - 1, F.lit(LONGEST))))
    df = held(df, starts=F.when(F.size("cut") > 0, F.filter(long, lambda s: s < size - 1)).otherwise(none))
    df = held(df, ends=after("starts", size), before=F.concat(F.array(F.lit(-1)), F.slice("starts", 1, F.greatest(F.size("starts") - 1, F.lit(0)))))
    begin = F.flatten(F.zip_with("starts", "ends", lambda s, n: F.transform(F.sequence(s + 1, F.greatest(s + 1, F.least(n, size - 1))), lambda e: span(s, e))))
    lead = F.flatten(F.zip_with("before", "starts", lambda p, s: F.when(s - 1 > p, F.transform(F.sequence(p + 1, s - 1), lambda b: span(b, s + 1))).otherwise(F.array().cast("array<long>"))))
    return held(df, spans=F.when(F.size("starts") > 0, F.concat(begin, lead)).otherwise(F.array().cast("array<long>"))).drop("hashes", "rolled", "cut", "starts", "ends", "before")


def dedup_lines(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """doc_id, text without repeated chunks, n_lines, n_removed for every row."""
    # ``rk`` names a row by id and content; copies are one row. One exchange of texts by it serves the comparison and the removal.
    gap = F.col("text").isNull()
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.concat(C.row_key(docs), F.when(docs["text"].isNull(), "-").otherwise("+")).alias("rk"))
    once = base.groupBy("rk").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("times"))
    lines = F.split("text", "\n", -1)
    part = lambda s: F.transform(F.sequence(first_of(s), last_of(s)), lambda i: F.get("lines", i))  # noqa: E731  # a slice would copy all lines
    spans = with_chunks(held(base.filter(~gap).select("rk", "text"), lines=lines).drop("text"), divisor)
    hashed = F.transform("spans", lambda s: F.struct(s.alias("span"), F.xxhash64(part(s)).alias("hash")))
    found = C.keep(spans.select("rk", F.inline(hashed)), "chunks")
    # A plain table, so that adaptive execution can split a hash that very many documents hold.
    again = C.keep(found.groupBy("hash").count().filter("count > 1").select("hash"), "again")
    nominated = C.keep(found.join(again, "hash", "left_semi").groupBy("rk").agg(F.collect_set("span").alias("spans")), "nominated")
    texts = held(once.join(nominated, "rk"), lines=lines, of=F.struct("doc_id", F.md5("text")))
    texts = texts.select("rk", "of", "times", F.inline(F.transform("spans", lambda s: F.struct(s.alias("span"), F.array_join(part(s), "\n").alias("chunk")))))
    # Of each group of equal bytes the first occurrence stays, also of a chunk that only shares its hash with others.
    groups = texts.groupBy("chunk").agg(F.min(F.struct("of", "span", "rk")).alias("at"), F.sum("times").alias("n"))
    kept = groups.select(F.col("at.rk").alias("rk"), F.col("at.span").alias("span"), F.col("n") == 1).toDF("rk", "span", "single")
    kept = kept.groupBy("rk").agg(F.collect_set("span").alias("kept"), F.collect_set(F.when(F.col("single"), F.col("span"))).alias("singles"))
    none = F.array().cast("array<long>")
    marks = nominated.join(kept, "rk", "left").select("rk", *[F.coalesce(c, none).alias(c) for c in ("spans", "kept", "singles")])
    rows = once.join(marks, "rk", "left").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    gone = F.coalesce(F.when(F.col("nth") > 1, F.array_except("spans", "singles")).otherwise(F.array_except("spans", "kept")), none)
    rows = held(rows, lines=F.coalesce(lines, F.array(F.lit(""))), gone=gone)
    out = F.array_distinct(F.flatten(F.transform("gone", lambda s: F.sequence(first_of(s), last_of(s)))))
    rows = held(rows, out=F.when(F.size("gone") > 0, out).otherwise(F.array().cast("array<int>")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "out")
    rows = held(rows, left=F.when(F.size("out") > 0, F.transform(left, lambda i: F.get("lines", i))).otherwise(F.col("lines")))
    count = F.when(gap, 0)
    return rows.select(
        "doc_id",
        F.when(~gap, F.array_join("left", "\n")).alias("text"),
        count.otherwise(F.size("lines")).cast("long").alias("n_lines"),
        count.otherwise(F.size("out")).cast("long").alias("n_removed"),
    )


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, md5(coalesce(text, '')) AS tk, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, tk, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM d WHERE text IS NOT NULL),
h AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l),
b AS (SELECT *, lead(h) OVER (PARTITION BY r ORDER BY i) AS after, count(*) OVER (PARTITION BY r) AS n FROM h),
c AS (SELECT r, i AS a, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), n) AS z, n FROM b WHERE i < n - 1 AND (i = 0 OR (h * 31 + after) % {DIVISOR} <> 0)),
s AS (SELECT r, n, unnest(range(a, z, {LONGEST})) AS s FROM c),
e AS (SELECT r, n, s, coalesce(lead(s) OVER (PARTITION BY r ORDER BY s), n) AS z, coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1) AS p FROM s WHERE s < n - 1),
w AS (SELECT r, s AS first, unnest(range(s + 1, greatest(s + 2, least(z + 1, n)))) AS last FROM e UNION ALL SELECT r, unnest(range(p + 1, s)) AS first, s + 1 AS last FROM e),
g AS (SELECT w.r, doc_id, tk, first, last, array_to_string(ls[first + 1:last + 1], chr(10)) AS chunk FROM w JOIN d ON d.r = w.r),
x AS (SELECT r, first, last, row_number() OVER (PARTITION BY chunk ORDER BY doc_id NULLS FIRST, tk, first, last, r) > 1 AS gone FROM g),
u AS (SELECT DISTINCT r, unnest(range(first, last + 1)) AS i FROM x WHERE gone),
o AS (SELECT l.r, string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE u.i IS NULL) AS text, count(*) AS n_lines, count(u.i) AS n_removed FROM l LEFT JOIN u ON u.r = l.r AND u.i = l.i GROUP BY l.r)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM d LEFT JOIN o USING (r)
"""
