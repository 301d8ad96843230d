"""Log-probabilities of whole documents under a gated recurrent language model trained on the corpus.

Tokens: words (A-Z lower-cased, runs without ASCII white space) and one end token a document; a word is known by its
64-bit hash (see ``word_hashes``).  Training documents are those whose crc32(doc_id as text) modulo ``FOLDS`` is not
``HELD_OUT``.

Counts come first and are exact: tasks count their documents' tokens, Spark adds them up by word, whatever the
vocabulary's size.  The softmax is factored over all tokens: the ``HEAD`` * 64 most frequent ones are words of the first
``HEAD`` classes; every other token, unknown ones included, belongs by its last two bytes to one of ``TAIL`` * 64 places in
the other classes.  Class and place are learned by the network; within a place of the tail a word has the probability
(c + 1) / (N_place + V_place + 1), the rest being for words that training lacks.

Texts are then encoded once: a table keeps each document's places (two bytes a token), its sums over the ``KNOWN`` most
frequent words and the hashes of its rarer words.  The network is trained on every training document, in ``ROUNDS``
rounds over disjoint parts of them.  A round deals its documents by a hash of id and text to lanes of about ``LANE``
tokens; a lane starts from the round's weights and trains on its documents in order of that hash, whichever task holds
it, and Spark averages the lanes' weights by tokens seen.  So the model does not depend on how the table is partitioned.
Then every document is scored, with state carried over its whole length.  Rarer words meet their counts in a shuffle
join and are added up by document.

Scale: the driver sees ``KNOWN`` hashes at most (found by a cutoff of frequency, so no task sorts the vocabulary), sums
of TAIL * 64 places and one set of weights (151,000 numbers), whatever the corpus; lanes grow in number with it.

Defined results: a null text is empty and has its end token alone; a null id counts as '' in the remainder; ids keep their
type; repeated rows are scored each and all count in training; without training documents N and c are 0 and the model is
uniform over its classes; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import gru, word_hashes

FOLDS, HELD_OUT = 7, 2
HEAD, TAIL = 32, 16  # classes
WORDS, PLACES = HEAD * gru.LEAVES, TAIL * gru.LEAVES
KNOWN = 1 << 19
ROUNDS = 2
LANE = 1 << 21  # tokens
MOST_TASKS = 20_000  # that lanes are dealt to; results do not depend on it
COUNTED = 1 << 22  # tokens whose counts a task adds up at once
SCORED = 1 << 22  # tokens that a task scores side by side
BINS = 64  # of counts, for a doubling

#: The place of the last two bytes of a word, and of the end token.
_PLACE = np.array([zlib.crc32(bytes(([i >> 8] if i >> 8 else []) + [i & 255])) % PLACES for i in range(1 << 16)], np.int16)
_END_PLACE = int(_PLACE[10])


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, their places in the tail, and tokens a text."""
    h, last, n = word_hashes.words_of(text)
    ends = np.cumsum(n)
    return np.insert(h, ends, np.uint64(word_hashes.END)), np.insert(_PLACE[last], ends, _END_PLACE), n + 1


def _counts(batches):
    held, size = [], 0

    def rows():
        code, words = pd.factorize(np.concatenate([h for h, _ in held]))
        place = np.empty(len(words), np.int16)
        place[code] = np.concatenate([p for _, p in held])
        cols = [pa.array(words.view(np.int64)), pa.array(np.bincount(code)), pa.array(place)]
        return pa.RecordBatch.from_arrays(cols, ["word", "n", "place"])

    for b in batches:
        h, place, _ = tokens_of(b.column("text"))
        held.append((h, place))
        size += len(h)
        if size >= COUNTED:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def count_tokens(texts: DataFrame) -> DataFrame:
    """word (hash), n, place (in the tail) of every distinct token."""
    n = C.map_batches(texts.select("text"), _counts, "word long, n long, place short")
    return C.keep(n.groupBy("word").agg(F.sum("n").alias("n"), F.min("place").alias("place")), "counts")


class Vocabulary:
    """The most frequent tokens with their counts, and the sums by place of those outside the softmax's words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, places: np.ndarray, total: int, distinct: int, n: np.ndarray, v: np.ndarray):
        self.words, self.counts, self.places, self.total, self.distinct, self.n, self.v = words, counts, places, total, distinct, n, v

    def tables(self):
        """An index of the hashes; by rank: ids, terms of the base score, terms of the second factor."""
        at, c = np.arange(len(self.words)), self.counts
        head = at < WORDS
        ids = np.where(head, at, WORDS + self.places).astype(np.int16)
        room = self.n + self.v + 1
        own = np.where(head, 0, np.log10((c + 1) / room[self.places]))
        return pd.Index(self.words), ids, np.log10((c + 1) / (self.total + self.distinct + 1)), own


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Known are the words of the highest frequencies, whole bins of frequency, up to ``KNOWN``."""
    bin_of = F.floor(F.log2("n") * BINS).cast("int")
    bins = counts.groupBy(bin_of.alias("bin")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy(F.col("bin").desc()).collect()  # a few thousand at most
    total, distinct, known, least = sum(r["n"] for r in bins), sum(r["v"] for r in bins), 0, 1 << 30
    for r in bins:
        if known + r["v"] > KNOWN:
            break
        known, least = known + r["v"], r["bin"]
    top = counts.filter(bin_of >= least).toArrow()
    words, c, places = (top.column(k).to_numpy() for k in ("word", "n", "place"))
    order = np.lexsort((words, -c))
    words, c, places = words[order], c[order], places[order]
    n, v = np.zeros(PLACES), np.zeros(PLACES)
    for r in counts.groupBy("place").agg(F.sum("n"), F.count("*")).collect():
        n[r[0]], v[r[0]] = r[1], r[2]
    np.subtract.at(n, places[:WORDS], c[:WORDS])
    np.subtract.at(v, places[:WORDS], 1)
    return Vocabulary(words.view(np.uint64), c, places, total, distinct, n, v)


def _first_weights(v: Vocabulary) -> np.ndarray:
    n = np.full(WORDS, -1.0)
    n[: min(WORDS, len(v.counts))] = v.counts[:WORDS]
    n = np.r_[n, v.n].reshape(HEAD + TAIL, -1)
    return gru.start(n)


_ENCODED = ["row", "doc_id", "held_out", "deal", "n_tokens", "n_known", "base", "own", "ids", "rare", "places"]


def _encode(v_of):
    def run(batches):
        known, ids_of, base_of, own_of = v_of.value.tables()
        for b in batches:
            h, place, n = tokens_of(b.column("text"))
            starts = np.cumsum(n) - n
            rank = known.get_indexer(h) if len(known) else np.full(len(h), -1)
            seen = rank >= 0
            ids = np.where(seen, ids_of[rank] if len(known) else 0, WORDS + place).astype("<i2").tobytes()
            add = lambda x: np.add.reduceat(np.where(seen, x[rank], 0), starts) if len(known) and len(starts) else np.zeros(len(n))  # noqa: E731, B023
            n_known = np.add.reduceat(seen, starts, dtype=np.int64) if len(starts) else starts
            edges = pa.array(np.r_[0, np.cumsum(n - n_known)].astype(np.int32))
            rare = [pa.ListArray.from_arrays(edges, pa.array(x[~seen])) for x in (h.view(np.int64), place)]
            own = pa.array([ids[2 * s : 2 * (s + k)] for s, k in zip(starts.tolist(), n.tolist(), strict=True)], pa.binary())
            cols = [*(b.column(c) for c in _ENCODED[:4]), pa.array(n), pa.array(n_known), pa.array(add(base_of)), pa.array(add(own_of)), own, *rare]
            yield pa.RecordBatch.from_arrays(cols, _ENCODED)

    return run


def encode(rows: DataFrame, v_of) -> DataFrame:
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, deal long, n_tokens long, n_known long, base double, own double, ids binary, rare array<long>, places array<short>"
    return C.keep(C.map_batches(rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "held_out", "deal", "text"), _encode(v_of), schema), "encoded")


def _train(weights: np.ndarray):
    def run(batches):
        sums, seen = np.zeros(len(weights)), 0
        lane, held, size, mine, state, own = None, [], 0, None, {}, 0

        def block():
            nonlocal held, size
            if size:
                gru.train(mine, HEAD + TAIL, held, state)
            held, size = [], 0

        def done():
            nonlocal sums, seen
            block()
            if own:
                sums += mine.astype(np.float64) * own
                seen += own

        for b in batches:
            for k, ids in zip(b.column("lane").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if k != lane:
                    done()
                    lane, mine, state, own = k, weights.copy(), {}, 0
                x = np.frombuffer(ids, "<i2").astype(np.int32)
                held.append(x)
                size, own = size + len(x), own + len(x)
                if size >= 4 * LANE:
                    block()
        done()
        for i in range(0, len(sums) if seen else 0, 10_000):
            part = sums[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + len(part), dtype=np.int32)), pa.array(part), pa.array(np.full(len(part), seen, np.int64))], ["i", "x", "n"])

    return run


def train(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    weights = _first_weights(v)
    lanes = max(1, -(-v.total // (ROUNDS * LANE)))
    for r in range(ROUNDS):
        part = encoded.filter(~F.col("held_out") & (F.pmod(F.xxhash64("deal"), F.lit(ROUNDS)) == r)).select(F.pmod("deal", F.lit(lanes)).alias("lane"), "deal", "ids")
        dealt = part.repartition(min(lanes, MOST_TASKS), "lane").sortWithinPartitions("lane", "deal")
        sums = C.map_batches(dealt.select("lane", "ids"), _train(weights), "i int, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x"))
        got = sums.toArrow()
        if got.num_rows:
            weights = weights.copy()
            weights[got.column("i").to_numpy()] = got.column("x").to_numpy()
    return weights


_SCORED = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score"]


def _score(weights: np.ndarray):
    def run(batches):
        m, held, size = gru.views(weights, HEAD + TAIL), [], 0

        def rows():
            t = pa.Table.from_batches(held).combine_chunks()
            logp = gru.score(m, [np.frombuffer(x, "<i2").astype(np.int32) for x in t.column("ids").to_pylist()]) / np.log(10)
            t = t.append_column("score", pa.array(logp + t.column("own").to_numpy()))
            return t.select(_SCORED).to_batches(5000)

        for b in batches:
            held.append(b)
            size += sum(map(len, b.column("ids").to_pylist())) // 2
            if size >= SCORED:
                yield from rows()
                held, size = [], 0
        if held:
            yield from rows()

    return run


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    deal = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text")
    rows = C.of_documents(docs, "doc_id", "text").select("doc_id", (C.remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"), deal.alias("deal"), "text")
    counts = count_tokens(rows.filter(~F.col("held_out")))
    v = vocabulary(counts)
    encoded = encode(rows, spark.sparkContext.broadcast(v))  # at most KNOWN words
    weights = train(encoded, v)
    kind = dict(encoded.dtypes)["doc_id"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double"
    scored = C.keep(C.map_batches(encoded.drop("deal", "rare", "places"), _score(weights), schema), "scored")
    room = F.broadcast(spark.createDataFrame([(i, float(x + 1)) for i, x in enumerate((v.n + v.v).tolist())], "place short, room double"))  # PLACES rows
    c = F.coalesce("n", F.lit(0))
    rare = (
        encoded.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("places").alias("place"))))
        .join(counts.select("word", "n"), "word", "left").join(room, "place")
        .groupBy("row")
        .agg(
            F.sum((c > 0).cast("long")).alias("more"),
            F.sum(F.log10((c + 1) / F.lit(float(v.total + v.distinct + 1)))).alias("base_more"),
            F.sum(F.log10((c + 1) / F.col("room"))).alias("score_more"),
        )
    )
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return scored.join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "more").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
        add("base", "base_more").alias("base_score"), add("score", "score_more").alias("score"),
    )
