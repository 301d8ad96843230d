"""The pipeline as a whole against its stages' rules."""

import corpus_pipeline
from hearthstat.llm import common as C
from hearthstat.llm import decontamination, mixing, quality, shingle_dedup


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = C.documents(spark, sf)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "mixing sources", "token shards"]
    good = {r["doc_id"] for r in quality.score_quality(docs, C.table(spark, sf, "labels")).filter("keep").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] in good}
    kept = docs.filter(docs["doc_id"].isin(list(rows)))
    first = {}
    for r in shingle_dedup.groups(kept).collect():  # held against all pairs of sets in test_near_copies
        first[r["root"]] = min(r["doc_id"], first.get(r["root"], r["doc_id"]))
    kept = kept.filter(kept["doc_id"].isin(list(first.values())))
    bad = {r["doc_id"] for r in decontamination.leaks(kept, C.table(spark, sf, "benchmark")).collect()}
    kept = kept.filter(~kept["doc_id"].isin(list(bad))) if bad else kept
    want = {r["doc_id"]: r["copies"] for r in mixing.plan(kept).select("doc_id", "copies").collect() if r["copies"]}
    got = corpus_pipeline.run(spark, sf).collect()
    have = {}
    for r in got:
        have[r["doc_id"]] = have.get(r["doc_id"], 0) + 1
    assert have == want
    order = mixing.schedule(mixing.plan(kept)).orderBy("position").collect()
    places = {}
    for r in order:
        places.setdefault(r["doc_id"], []).append(r["position"])
    shards = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    single = [places[i][0] for i in shards if len(places[i]) == 1]
    assert single == sorted(single)  # the curriculum's order reaches the shards
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
