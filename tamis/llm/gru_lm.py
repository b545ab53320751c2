"""Log-likelihood of whole documents under a gated recurrent language model, beside a smoothed unigram base.

Words are counted over all training documents, and the counts stay a distributed table. The 2046 most frequent words are the
model's vocabulary; any other word has the model's probability of "other" times its smoothed share of the counts of the words
outside the vocabulary, so model and base give probabilities to the same events.

1. Words are counted. Counts of the HEAD_WORDS most frequent words at most (12 bytes each) go to the executors.
2. Each document is coded once: its words' places in the vocabulary, two bytes each, and its sums for the base.
3. The network is trained on every word of every training document. Documents are dealt to ROUNDS rounds by a hash; in each,
   every task trains a copy of the network on its documents, and the copies' mean, weighted by words, is the next round's network.
   A task holds BATCH_WORDS words at most beside it; a copy (some 1 MB) is sent to the mean in chunks, which are added up apart.
4. Each document is scored from its start to its end. Words that the head hasn't are joined with the table of counts, in a shuffle.

Which documents train a copy together depends on how rows lie in tasks, so that on another layout the network is another one of the same
quality, and scores differ with it. Counts and bases don't depend on it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, text_chunks
from .gru_model import END, Gru, create, score, train
from .wordscan import scan

VOCABULARY = 2048
HEAD_WORDS = 1 << 20
HIDDEN = 16
ROUNDS = 6
RATE = 0.5
#: The end of a document among word hashes.
END_HASH = 1
#: Words that a task trains on or scores together, and distinct words that it counts before it passes them on.
BATCH_WORDS = 3_000_000
COUNT_WORDS = 500_000
#: Numbers of a network that travel together.
CHUNK = 8192
#: Logarithms are added up as whole numbers of this part of one, so that sums don't depend on their order.
GRAIN = float(1 << 30)


@dataclass
class Unigrams:
    """words: all training tokens; distinct: their kinds; head: hashes in order, counts, places in the vocabulary (0: outside)."""

    table: DataFrame
    words: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    head_place: np.ndarray
    outside: int  # of training kinds outside the vocabulary, the sum of count + 1, and 1 for all unseen words
    vocabulary_counts: np.ndarray


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def count_words(docs: DataFrame) -> DataFrame:
    """__word (hash), __c over all rows' __text; each document has one END_HASH more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, ends = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_signed(words)), pa.array(counts)], ["__word", "__c"])

        for batch in batches:
            ends += batch.num_rows
            for piece in text_chunks(batch, "__text"):
                more, n = np.unique(scan(piece.column("__text")).hashes, return_counts=True)
                words, at = np.unique(np.concatenate((words, more)), return_inverse=True)
                counts = np.bincount(at, weights=np.concatenate((counts, n)), minlength=len(words)).astype(np.int64)
                if len(words) > COUNT_WORDS:
                    yield out()
                    words, counts = words[:0], counts[:0]
        words, counts = np.append(words, np.uint64(END_HASH)), np.append(counts, ends)
        yield out()

    return docs.select("__text").mapInArrow(run, "__word bigint, __c bigint").groupBy("__word").agg(F.sum("__c").alias("__c")).where("__c > 0")


def unigrams(docs: DataFrame, vocabulary: int, head_words: int) -> Unigrams:
    table = materialise(count_words(docs), "lm-counts")
    # Kinds and tokens by size of their count, in sixteenths of a doubling: a thousand rows at most.
    size = F.floor(16 * F.log2(F.col("__c").cast("double"))).cast("int")
    sizes = sorted(table.groupBy(size.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("__c").alias("c")).collect(), reverse=True)
    words, distinct = sum(r["c"] for r in sizes), sum(r["n"] for r in sizes)
    least, kinds = 1 << 30, 0
    for r in sizes:
        if kinds + r["n"] > head_words:
            break
        least, kinds = r["s"], kinds + r["n"]
    head = table.where(size >= least).toArrow()
    hashes = head.column("__word").to_numpy().view(np.uint64)
    counts = head.column("__c").to_numpy()
    order = np.argsort(hashes)
    hashes, counts = hashes[order], counts[order].astype(np.int64)
    best = np.lexsort((hashes, -counts))
    best = best[hashes[best] != END_HASH][: vocabulary - 2]
    place = np.zeros(len(hashes), np.int32)
    place[best] = np.arange(2, 2 + len(best))
    place[hashes == END_HASH] = END
    inside = place > 0
    outside = words + distinct - int((counts[inside] + 1).sum()) + 1
    of_place = np.zeros(2 + len(best), np.int64)
    of_place[place[inside]] = counts[inside]
    of_place[0] = words - of_place.sum()
    return Unigrams(table, words, distinct, hashes, counts, place, outside, of_place)


def _look_up(head: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places in head, -1 where a hash isn't there."""
    if not len(head):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(head, hashes), len(head) - 1)
    return np.where(head[at] == hashes, at, -1)


_FIELDS = "n_tokens bigint, __known bigint, __log bigint, __outside bigint, __outside_log bigint, __places binary, __tail array<bigint>, __tail_n array<int>"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_KINDS = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]


def code_documents(docs: DataFrame, counts: Unigrams, rounds: int) -> DataFrame:
    """Per row of docs (__id, __text, __training): what the head says, the places of its words, the words that the head hasn't, with
    their numbers; and __round, the round that trains on it (-1: none)."""
    id_type = docs.schema["__id"].dataType.simpleString()
    head, place, logs = counts.head, counts.head_place, np.rint(np.log10(counts.head_counts + 1.0) * GRAIN).astype(np.int64)
    end = _look_up(head, np.array([END_HASH], np.uint64))[0]

    def kernel(piece: pa.RecordBatch) -> pa.RecordBatch:
        found = scan(piece.column("__text"))
        at = _look_up(head, found.hashes)
        in_head = at >= 0
        where = np.where(in_head, place[at] if len(head) else 0, 0).astype("<u2")
        value = np.where(in_head, logs[at] if len(head) else 0, 0)
        outside = where == 0
        # Running sums over all words of the piece; a document's sum is a difference.
        sums = [np.concatenate(([0], np.cumsum(x))) for x in (in_head, value, outside, np.where(outside, value, 0))]
        first, last = found.first[:-1], found.first[1:]
        known, log, n_out, out_log = (x[last] - x[first] for x in sums)
        raw, tails, numbers = where.tobytes(), [], []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            tail, n = np.unique(found.hashes[a:b][~in_head[a:b]], return_counts=True)
            tails.append(_signed(tail))
            numbers.append(n.astype(np.int32))
        places = [raw[2 * a : 2 * b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        columns = [last - first + 1, known + int(end >= 0), log + (logs[end] if end >= 0 else 0), n_out, out_log, places, tails, numbers]
        arrays = [pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)]
        return pa.RecordBatch.from_arrays([piece.column("__id"), piece.column("__training"), *arrays], ["__id", "__training", *_NAMES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in text_chunks(batch, "__text"):
                yield kernel(piece)

    coded = docs.select("__id", "__training", "__text").mapInArrow(run, f"__id {id_type}, __training boolean, {_FIELDS}")
    # The hash takes in the words, so that null ids are dealt out too.
    return coded.withColumn("__round", F.when(F.col("__training"), F.pmod(F.xxhash64("__id", "__places"), F.lit(rounds)).cast("int")).otherwise(-1))


def _documents(batches: Iterator[pa.RecordBatch], sizes: int = BATCH_WORDS) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Rows with __places, and their documents with the end, so many words at a time; a longer document is whole."""
    rows, docs, words = [], [], 0
    for batch in batches:
        start = 0
        for i, raw in enumerate(batch.column("__places")):
            doc = np.append(np.frombuffer(raw.as_buffer() or b"", "<u2").astype(np.int32), np.int32(END))
            if docs and words + len(doc) > sizes:
                yield [*rows, batch.slice(start, i - start)], docs
                rows, docs, words, start = [], [], 0, i
            docs.append(doc)
            words += len(doc)
        rows.append(batch.slice(start))
    if docs:
        yield rows, docs


def fit(coded: DataFrame, counts: Unigrams, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = RATE, seed: int = 7) -> Gru:
    """Train on all coded rows (__places) with a __round from 0. Without any the network is as created."""
    network = create(counts.vocabulary_counts, hidden, seed)
    for r in range(rounds):
        network = _round(coded.where(F.col("__round") == r).select("__places"), network, rate)
    return network


def _round(docs: DataFrame, network: Gru, rate: float) -> Gru:
    """The mean of copies of the network, each trained by a task on its documents."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = None, 0
        for _, texts in _documents(batches):
            own = train(shared.value.copy() if own is None else own, texts, rate)
            words += sum(map(len, texts))
        if own is not None:
            numbers = own.flat().astype("<f4")
            chunks = [numbers[a : a + CHUNK].tobytes() for a in range(0, len(numbers), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(chunks), dtype=np.int32)), pa.array([words] * len(chunks), pa.int64()), pa.array(chunks, pa.binary())], ["__chunk", "__words", "__numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for chunk, words, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n, total = totals.get(chunk, (0, 0.0))
                totals[chunk] = (n + words, total + words * np.frombuffer(raw, "<f4").astype(np.float64))
        found = sorted(totals)
        means = [(totals[c][1] / totals[c][0]).astype("<f4").tobytes() for c in found]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(means, pa.binary())], ["__chunk", "__numbers"])

    copies = docs.mapInArrow(learn, "__chunk int, __words bigint, __numbers binary")
    found = copies.repartition("__chunk").mapInArrow(add, "__chunk int, __numbers binary").collect()
    shared.unpersist()
    return network.filled(np.frombuffer(b"".join(x["__numbers"] for x in sorted(found)), "<f4")) if found else network


def score_documents(coded: DataFrame, network: Gru) -> DataFrame:
    """coded without __places and __round, with __network: the log10 probability of each row's places."""
    kept = [f for f in coded.schema.fields if f.name not in ("__places", "__round", "__training")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _documents(batches):
            table = pa.Table.from_batches(rows).combine_chunks()
            found = pa.array(score(network, texts) / np.log(10))
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in names), found], [*names, "__network"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    return coded.select(*names, "__places").mapInArrow(run, f"{fields}, __network double")


def log_likelihood(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", vocabulary: int = VOCABULARY, head_words: int = HEAD_WORDS, hidden: int = HIDDEN, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text).

    A null text counts as empty and is one end token. Repeated rows are trained on and scored each by itself; texts that are equal get
    the same base, and scores equal but for rounding of single precision. If no row is for training, every word is unseen. Null ids are
    scored, and trained on where the condition says so. An empty table gives no rows. Other columns are not carried.
    """
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.coalesce(training, F.lit(False)).alias("__training"))
    counts = unigrams(narrow.where("__training").select("__text"), vocabulary, head_words)
    coded = materialise(code_documents(narrow, counts, rounds).withColumn("__row", F.monotonically_increasing_id()), "lm-coded")
    rows = materialise(score_documents(coded, fit(coded, counts, hidden, rounds)), "lm-rows")
    discard(coded)
    tails = rows.select("__row", F.explode(F.arrays_zip(F.col("__tail").alias("word"), F.col("__tail_n").alias("n"))).alias("x")).select("__row", F.col("x.word").alias("__word"), F.col("x.n").alias("__n"))
    log = F.rint(F.log10(F.col("__c") + 1.0) * GRAIN).cast("bigint")
    joined = tails.join(counts.table, "__word").groupBy("__row").agg(F.sum("__n").alias("__tail_known"), F.sum(F.col("__n") * log).alias("__tail_log"))
    full = rows.drop("__tail", "__tail_n").join(joined, "__row", "left").fillna({"__tail_known": 0, "__tail_log": 0})
    base = (F.col("__log") + F.col("__tail_log")) / F.lit(GRAIN) - F.col("n_tokens") * F.lit(float(np.log10(counts.words + counts.distinct + 1)))
    model = F.col("__network") + (F.col("__outside_log") + F.col("__tail_log")) / F.lit(GRAIN) - F.col("__outside") * F.lit(float(np.log10(counts.outside)))
    return full.select(F.col("__id").alias(id_col), "n_tokens", (F.col("__known") + F.col("__tail_known")).alias("n_known"), F.lit(counts.words).cast("bigint").alias("train_tokens"), base.alias("base_score"), model.alias("score"))
