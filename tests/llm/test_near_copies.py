"""The pipeline's near-duplicates against all pairs of shingle sets."""

import random

import corpus_pipeline
from hearthstat.llm import hamming, shingle_dedup, simhash_dedup


def edited(g, words, n):
    out = list(words)
    for i in g.sample(range(len(out)), n):
        out[i] = f"edit{g.randrange(10**6)}"
    return out


def similarity(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / max(1, len(sets[0] | sets[1])) if sets[0] or sets[1] else 1.0


def plain_groups(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8 and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def test_stage_drops_near_copies_of_similarity_08(spark):
    g = random.Random(3)
    texts = ["", "one two", "One  two", "one two three"]
    for _ in range(12):
        base = [f"w{g.randrange(400)}" for _ in range(g.randrange(60, 400))]
        texts += [" ".join(edited(g, base, int(len(base) * share))) for share in (0, 0.01, 0.02, 0.03, 0.08)]
    chain = [f"c{i}" for i in range(200)]  # each link near the last only: groups go through third texts
    for _ in range(6):
        texts.append(" ".join(chain))
        chain = edited(g, chain, 3)
    want = plain_groups(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.one_of_each(spark, docs, "").collect()} == set(want)
    far = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8 and (simhash_dedup.simhash(texts[i]) ^ simhash_dedup.simhash(texts[j])).bit_count() > 4]
    assert len(far) > 10  # what op3's radius cannot find


def test_groups(docs, rows, none):
    got = shingle_dedup.groups(docs).collect()
    assert len(got) == len(rows) and shingle_dedup.keep_first(none).count() == 0
    of = {r["doc_id"]: r["root"] for r in got}
    assert of[0] == of[1] == of[2] and of[5] == of[6] == of[7] and of[9] != of[3]


def test_stage_keeps_one_row_of_each_group(spark):
    base = " ".join(f"t{i}" for i in range(100))
    rows = [(None, "no id at all"), (None, "another without an id"), (1, base), (2, base.replace("t50 ", "x ")), (2, "a clean text that shares its id"), (3, "twice"), (3, "twice"), (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, corpus_pipeline.one_of_each(spark, docs, "").collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], rows[4], rows[5]], key=str)


def test_work_on_texts_with_one_template_is_linear(spark):
    """Texts that share half their words, no pair alike: few are nominated, and a row nominates a few at most."""
    counts = []
    for n in (300, 600):
        g = random.Random(n)
        shared = [f"s{i}" for i in range(60)]
        texts = [" ".join(shared + [f"u{g.randrange(10**6)}" for _ in range(60)]) for _ in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        rows = shingle_dedup.C.map_batches(docs.selectExpr("doc_id", "text", "cast(doc_id as string) as row"), shingle_dedup._sketch(5), "row string, doc_id long, set long, keys array<long>, sig binary")
        counts.append(shingle_dedup.nominated(shingle_dedup.C.keep(rows, "test")).count())
    assert counts[1] <= max(20, 3 * counts[0]) and counts[1] < 600, counts


def test_dense_values(spark, monkeypatch):
    """Values that are dense at every level still find what is alike; copies give no pairs by their square."""
    monkeypatch.setattr(shingle_dedup, "DENSE", 8)
    g = random.Random(9)
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(edited(g, base, 3)) for _ in range(60)] + [" ".join(edited(g, [f"x{i}" for i in range(200)], 2)) for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r["doc_id"]: r["root"] for r in shingle_dedup.groups(docs).collect()}
    want = plain_groups(texts)
    assert len(set(of.values())) == len(set(want)) and all((of[i] == of[j]) == (want[i] == want[j]) for i in range(65) for j in range(i))


def test_first_round_is_multi_index_hashing_of_fingerprints(spark, monkeypatch):
    """Without any band, pairs within the radius are linked, after the exact check; farther ones are not."""
    monkeypatch.setattr(shingle_dedup, "nominated", lambda once, bands: once.selectExpr("set as a", "set as b").limit(0))
    g = random.Random(11)
    bases = [[f"w{g.randrange(5000)}" for _ in range(600)] for _ in range(20)]
    texts = [" ".join(edited(g, base, n)) for base in bases for n in (0, 1, 12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    of = {r["doc_id"]: r["root"] for r in shingle_dedup.groups(docs).collect()}
    prints = [simhash_dedup.of_hashes(shingle_dedup.shingles(t, 5)) for t in texts]
    pairs = [(i, j, (prints[i] ^ prints[j]).bit_count()) for i in range(len(texts)) for j in range(i)]
    near = [(i, j) for i, j, d in pairs if d <= 4 and similarity(texts[i], texts[j]) >= 0.8]
    assert len(near) >= 15 and all(of[i] == of[j] for i, j in near)
    assert len(set(of.values())) > len(bases)  # what lies farther is left to the bands


def test_near_copies_that_are_linked_nominate_nothing(spark):
    """Rows that tasks make for a large group of near copies, and links to other components, which stay."""
    g = random.Random(5)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(edited(g, base, 2)) for _ in range(80)]
    sig = shingle_dedup.np.stack([shingle_dedup.np.frombuffer(shingle_dedup.signature(shingle_dedup.minima(shingle_dedup.shingles(t, 5))), "u1") for t in texts])
    assert len(shingle_dedup.forest(sig)) >= 79
    assert shingle_dedup.forest(sig, shingle_dedup.np.zeros(80, int)) == []
    two = shingle_dedup.np.arange(80) // 40
    across = shingle_dedup.forest(sig, two)
    assert across and all(two[i] != two[j] for i, j in across)


def test_components_keep_few_partitions(spark):
    """Edges of a round lie in as few partitions as their number asks for, so that the driver follows few tasks; the same roots come out."""
    links = spark.range(400).selectExpr("id as a", "id - id % 10 as b").repartition(40, "a")
    few = hamming.components(links, rows=50_000)
    assert few.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, hamming.components(links).collect())) == [(i, i - i % 10) for i in range(400) if i % 10]


def test_a_pair_is_nominated_once(spark, monkeypatch):
    """Near copies share many keys of either kind; the rows that tasks make of a level are different pairs."""
    made, nominate, keep, near = spark.sparkContext.accumulator(0), shingle_dedup._near, shingle_dedup.C.keep, []

    def counted(batches):
        for b in nominate(batches):
            made.add(b.num_rows)
            yield b

    def kept(df, name, *rest):
        out = keep(df, name, *rest)
        near.extend([out.count()] * (name == "near"))
        return out

    monkeypatch.setattr(shingle_dedup, "_near", counted)
    monkeypatch.setattr(shingle_dedup.C, "keep", kept)
    monkeypatch.setattr(shingle_dedup, "DENSE", 100)
    g = random.Random(12)
    texts = [" ".join(edited(g, [f"{c}{i}" for i in range(200)], 4)) for c in "abcdef" for _ in range(40)]
    texts += [" ".join(edited(g, [f"g{i}" for i in range(200)], 12)) for _ in range(250)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = shingle_dedup.C.map_batches(docs.selectExpr("doc_id", "text", "cast(doc_id as string) as row"), shingle_dedup._sketch(5), "row string, doc_id long, set long, keys array<long>, sig binary")
    assert shingle_dedup.nominated(keep(rows, "test")).count() and sum(near) == made.value > 240


def test_pairs_of_an_earlier_key_are_left_to_it():
    """What runs leave to one another is found by one of them: together they span what agrees."""
    np, g = shingle_dedup.np, random.Random(13)
    base = [f"w{i}" for i in range(200)]
    sig = np.stack([np.frombuffer(shingle_dedup.signature(shingle_dedup.minima(shingle_dedup.shingles(" ".join(edited(g, base, 1)), 5))), "u1") for _ in range(30)])
    keys = [np.array(sorted(g.sample(range(6), 3))) for _ in range(30)]
    found = []
    for k in range(6):
        run = [i for i in range(30) if k in keys[i]]
        pairs = shingle_dedup.forest(sig[run], earlier=[keys[i][keys[i] < k] for i in run])
        found += [(run[i], run[j]) for i, j in pairs]
    assert len(found) == len(set(found))
    root = list(range(30))
    for a, b in found:
        root = [root[a] if r == root[b] else r for r in root]
    assert len(set(root)) == 1
