"""The filter audit against running every order over the documents one by one."""

import re
from itertools import permutations

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthstat.llm import filter_audit as A


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=200))
def test_positional_popcount(words):
    assert A.positional_popcount(np.array(words, np.uint32)).tolist() == [sum(w >> b & 1 for w in words) for b in range(32)]


def test_words():
    assert all(bool(int(A.WORDS[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def plain(rows, labels):
    """rows: (doc_id, lang, text); labels: (doc_id, quality, toxic)."""
    docs = []
    for i, lang, text in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t))}
        fails["E"] = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in rows)
        known = [x for x in labels if i is not None and x[0] == i]
        docs.append((lang or "", fails, any(x[1] == 1 for x in known), any(x[2] == 1 for x in known)))
    out = {}
    for part in {d[0] for d in docs}:
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if d[1][f]], [d for d in left if not d[1][f]]
                total[f] += len(gone)
                every = [d for d in docs if d[0] == part and d[1][f]]
                only = [d for d in every if sum(d[1].values()) == 1]
                out[part, order, step] = [len(left), len(gone), len(every) - len(gone), len(only), sum(d[2] for d in gone), sum(d[3] for d in gone), f]
        # Shapley totals need all orders of a part.
        for k in [k for k in out if k[0] == part]:
            out[k][-1] = total[out[k][-1]]
    return out


def test_awkward_documents(spark, docs, none):
    extra = " ".join(f"v{i}" for i in range(120))
    more = [(100, extra, "en", "a"), (101, extra, None, "a"), (101, extra, "", "a"), (None, extra, "en", "a"), (102, "AB # CD " * 60, "en", None), (103, "", "xx", "a"), (104, None, "xx", "a"), (105, extra + " %", "de", "b")]
    df = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string")).selectExpr("*", "'clash' as part", "1 as mask", "2 as label", "'d' as digest")
    marks = [(100, 1, 0), (101, 0, 1), (101, 1, None), (102, 1, 1), (12, 1, 1), (None, 1, 1), (0, None, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").selectExpr("*", "'clash' as part")
    want = plain([(r["doc_id"], r["lang"], r["text"]) for r in df.collect()], marks)
    got = {tuple(r[:3]): list(r[3:]) for r in A.audit(df, labels).collect()}
    assert got == want
    again = {tuple(r[:3]): list(r[3:]) for r in A.audit(df.repartition(7), labels.repartition(3)).collect()}
    assert again == want
    assert A.audit(none, labels).count() == 0
    few = {tuple(r[:3]): list(r[3:]) for r in A.audit(df, labels.limit(0)).collect()}
    assert {k: v[:4] for k, v in few.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in few.values())


def test_sql(spark):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = A.audit(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet"))
    names = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(f"SELECT {names} FROM ({A.SQL})").fetchall())
