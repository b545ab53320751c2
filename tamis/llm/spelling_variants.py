"""Groups of spelling variants: words that differ by one code point, by forward and backward minimal acyclic automata.

1. Words are counted over all texts, by Spark's own functions.
2. Of two words that differ by one error, either the first or the second half of one of them is in the other. So each word is a query
   under its first half (the error comes after it) and under its second half, and an answer under the halves that words one shorter,
   as long, and one longer can have. A key is the query's length and the part that has no error.
3. A key that more than MOST entries have, or entries of more than MOST_LETTERS letters, is split in two again: the error is in either half of what is left. This ends at the
   latest when one place is left, where a key has a few hundred words at most, as many as there are letters. No word is left out.
4. Tasks read their keys in order, in pieces of whole keys. The answers of a piece become a minimal acyclic automaton, of the words for keys
   without error at the start, of the words from the back for the others. Its states carry the number of words below, so that a path
   adds up to the number of its word (a perfect hash). All queries of a piece go through it together: exactly up to the error's first
   possible place, with one error from there on, exactly after it.
5. Pairs that both directions found are made one. Roots follow forms by doubling.

Letters are a-z, once A-Z are lower-cased, and U+00C0 to U+00FF. Null texts have no words; a null id counts as empty where words are altered.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, discard, materialise, release_memory
from .wordscan import mix

LETTERS = "[a-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Entries of a key, and letters of all of them, beyond which it is split further.
MOST = 8192
MOST_LETTERS = 1 << 18
#: Bytes of words that an automaton is made of at once, and entries.
PIECE_BYTES = 1 << 21
PIECE_ROWS = 1 << 16


class Automaton:
    """The minimal acyclic automaton of sorted distinct byte strings; words are numbered in their order."""

    def __init__(self, words: np.ndarray) -> None:
        n, size = len(words), words.dtype.itemsize
        grid = words.view(np.uint8).reshape(n, size)
        length = np.char.str_len(words)
        shared = np.zeros(n, np.int64)
        shared[1:] = (grid[1:] != grid[:-1]).argmax(1)
        # A trie first: each word has new nodes for what it does not share with the one before. Node 0 is the root.
        fresh = length - shared
        start = np.cumsum(fresh) - fresh + 1
        row = np.repeat(np.arange(n), fresh)
        depth = np.arange(1, len(row) + 1) - np.repeat(start - shared, fresh)
        char = np.concatenate(([0], grid[row, depth])).astype(np.uint64)
        depth = np.concatenate(([-1], depth))
        above = np.arange(-1, len(row))
        for d in range(int(shared.max())):
            latest = np.maximum.accumulate(np.where((shared <= d) & (length > d), np.arange(n), 0))
            own = shared == d + 1
            above[start[own]] = start[latest[own]] + d - shared[latest[own]]
        above[start[shared == 0]] = 0
        above[0] = 0
        self.final_node = np.zeros(len(depth), bool)
        self.final_node[start + fresh - 1] = True
        below = self.final_node.astype(np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(size + 1))
        for seed in range(1, 9):
            # States are nodes with equal sets of endings: equal sums over their edges, from the deepest to the root.
            value = self.final_node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 * seed % (1 << 64))
            for d in range(size - 1, -1, -1):
                at = order[cuts[d] : cuts[d + 1]]
                np.add.at(value, above[at], mix(mix(value[at] + np.uint64(seed)) + char[at]))
                if seed == 1:
                    np.add.at(below, above[at], below[at])
            _, first, state = np.unique(value, return_index=True, return_inverse=True)
            if self._edges(first, state, above, char.astype(np.int64), below):
                break
        else:
            raise RuntimeError("states of different endings have equal values")

    def _edges(self, first: np.ndarray, state: np.ndarray, above: np.ndarray, char: np.ndarray, below: np.ndarray) -> bool:
        """Edges of the states, from one node of each; whether all nodes of a state have just these."""
        kept = np.zeros(len(above), bool)
        kept[first] = True
        child = np.arange(1, len(above))
        own = child[kept[above[1:]]]
        key = state[above[own]] * 256 + char[own]
        own = own[np.argsort(key, kind="stable")]
        self.key = np.sort(key)
        self.char = char[own]
        self.target = state[own]
        self.final = self.final_node[first]
        self.first = np.searchsorted(self.key, np.arange(len(first) + 1) * 256)
        sums = np.cumsum(below[own])
        self.skip = sums - below[own]
        begins = self.first[:-1][np.diff(self.first) > 0]
        self.skip -= np.repeat(self.skip[begins], np.diff(np.append(begins, len(own))))
        self.skip += self.final[self.key >> 8]
        self.root = int(state[0])
        at = np.searchsorted(self.key, state[above[1:]] * 256 + char[1:])
        same = at < len(self.key)
        at = np.minimum(at, len(self.key) - 1)
        same &= (self.key[at] == state[above[1:]] * 256 + char[1:]) & (self.target[at] == state[1:])
        degrees = np.bincount(above[1:], minlength=len(above))
        return bool(same.all() and (degrees == np.diff(self.first)[state]).all() and (self.final_node == self.final[state]).all())

    def follow(self, state: np.ndarray, char: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the states have an edge with that letter, and the edges of these."""
        wanted = state * 256 + char
        at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == wanted)
        return hit, at[hit]

    def near(self, queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of queries and of the words that differ from them by one error, which is at places low to high."""
        grid = queries.view(np.uint8).reshape(len(queries), queries.dtype.itemsize).astype(np.int64)
        length = np.char.str_len(queries)
        # Query, state and number so far of the paths without error, and of those with one.
        plain = (np.arange(len(queries)), np.full(len(queries), self.root), np.zeros(len(queries), np.int64))
        wrong = tuple(np.zeros(0, np.int64) for _ in range(3))
        found = []
        for at in range(int(length.max()) + 1):
            q, s, k = plain
            live = np.flatnonzero((at >= low[q]) & (at <= high[q]))
            degree = self.first[s[live] + 1] - self.first[s[live]]
            of = np.repeat(live, degree)
            edge = np.arange(len(of)) + np.repeat(self.first[s[live]] - (np.cumsum(degree) - degree), degree)
            added = (q[of], self.target[edge], k[of] + self.skip[edge])
            inside = (at < high[q]) & (at < length[q])
            letter = grid[:, min(at, grid.shape[1] - 1)]
            other = inside[of] & (self.char[edge] != letter[q[of]])
            left_out = live[inside[live]]
            now = tuple(np.concatenate(x) for x in zip(wrong, added, strict=True))
            ends = (length[now[0]] == at) & self.final[now[1]]
            found.append((now[0][ends], now[2][ends]))

            def step(q: np.ndarray, s: np.ndarray, k: np.ndarray, at: int = at, letter: np.ndarray = letter) -> tuple[np.ndarray, ...]:
                more = np.flatnonzero(length[q] > at)
                hit, e = self.follow(s[more], letter[q[more]])
                return q[more[hit]], self.target[e], k[more[hit]] + self.skip[e]

            moved = step(*now)
            wrong = tuple(np.concatenate(x) for x in zip(moved, (a[other] for a in added), (q[left_out], s[left_out], k[left_out]), strict=True))
            ahead = at < high[q]
            plain = step(q[ahead], s[ahead], k[ahead])
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _reversed(words: np.ndarray) -> np.ndarray:
    size = words.dtype.itemsize
    grid = words.view(np.uint8).reshape(len(words), size)
    length = np.char.str_len(words)
    at = length[:, None] - 1 - np.arange(size)
    return np.where(at >= 0, np.take_along_axis(grid, np.maximum(at, 0), 1), 0).astype(np.uint8).view(f"S{size}").ravel()


def match_piece(word: list[str], n: np.ndarray, length: np.ndarray, low: np.ndarray, high: np.ndarray, forward: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of words that differ by one error, and the second's count, of the entries of whole keys in one piece."""
    raw = np.array([w.encode("latin-1") for w in word])
    out = []
    for ahead in (True, False):
        own = np.flatnonzero(forward == ahead)
        if not len(own):
            continue
        texts = raw[own] if ahead else _reversed(raw[own])
        words, first = np.unique(texts, return_index=True)
        asks = np.flatnonzero(np.char.str_len(texts) == length[own])
        a, b = low[own][asks], high[own][asks]
        if not ahead:
            a, b = length[own][asks] - b, length[own][asks] - a
        if len(asks):
            query, number = Automaton(words).near(texts[asks], a, b)
            out.append(np.unique(np.stack((own[asks[query]], own[first[number]])), axis=1))
    pairs = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
    return pairs[0], pairs[1], n[pairs[1]]


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs from entries that lie by length and key."""

    def pairs(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).to_numpy() for c in ("n", "m", "a", "b", "forward")}
        word = table.column("word")
        left, right, n = match_piece(word.to_pylist(), column["n"], column["m"], column["a"], column["b"], column["forward"])
        return pa.RecordBatch.from_arrays([word.take(left).combine_chunks(), word.take(right).combine_chunks(), pa.array(n)], ["word", "near", "near_n"])

    held: list[pa.RecordBatch] = []
    rows, last = 0, None
    for batch in batches:
        keys, lengths = batch.column("key").to_pylist(), batch.column("m").to_pylist()
        start = 0
        for i, (key, m) in enumerate(zip(keys, lengths, strict=True)):
            if key != last:
                size = rows + i - start
                if size >= PIECE_ROWS or size * (m + 1) >= PIECE_BYTES:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield pairs(pa.Table.from_batches(held))
                    release_memory()
                    held, rows, start = [], 0, i
                last = key
        if batch.num_rows > start:
            held.append(batch.slice(start))
            rows += batch.num_rows - start
    if held:
        yield pairs(pa.Table.from_batches(held))
        release_memory()


@dataclass(frozen=True)
class Alteration:
    """A run is altered if `modulus` divides the crc32 of `<id>:<run>`: it loses the code point at that value modulo its length."""

    modulus: int = 199


def count_words(docs: DataFrame, id_col: str, text_col: str, least_chars: int, least_count: int, alter: Alteration | None) -> DataFrame:
    """Words and their numbers of occurrences n in all texts."""
    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    word: Column = F.col("run")
    if alter:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % alter.modulus == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    runs = runs.select(word.alias("word")).where(F.length("word") >= least_chars)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """rows of word, n, m (a query's length), a and b (the places of its error), forward: with the key, its part without error."""
    rest = F.col("m") - F.col("b")
    return rows.withColumn("key", F.concat_ws("|", F.col("forward").cast("string"), "m", "a", "b", F.substring("word", F.lit(1), F.col("a")), F.substring("word", F.length("word") - rest + 1, rest)))


def entries(words: DataFrame) -> DataFrame:
    """Six entries a word: for a query one shorter, as long and one longer, with the error in either half."""
    m = F.explode(F.array(*(F.length("word") + d for d in (-1, 0, 1)))).alias("m")
    half = F.shiftright("m", 1)
    halves = F.array(F.struct(half.alias("a"), F.col("m").alias("b"), F.lit(True).alias("forward")), F.struct(F.lit(0).alias("a"), half.alias("b"), F.lit(False).alias("forward")))
    return _keyed(words.select("word", "n", m).select("*", F.explode(halves).alias("p")).select("word", "n", "m", "p.*"))


def split(rows: DataFrame) -> DataFrame:
    """Two entries for each: the error is in the first or the second half of its places."""
    middle = F.shiftright(F.col("a") + F.col("b"), 1)
    halves = F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b"))
    return _keyed(rows.select("word", "n", "m", "forward", F.explode(halves).alias("p")).select("word", "n", "m", "p.a", "p.b", "forward"))


def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """word, near, near_n: every two words that differ by one error, both ways round, once. words: distinct words and their n."""
    rows, parts = entries(words), []
    while True:
        sizes = rows.where("b - a > 1").groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.sum(F.length("word")).alias("letters"))
        large = materialise(sizes.where((F.col("size") > most) | (F.col("letters") > MOST_LETTERS)).select("key"), "spelling-large")
        if large.isEmpty():
            parts.append(rows)
            break
        parts.append(rows.join(bounded_broadcast(large), "key", "left_anti"))
        rows = split(rows.join(bounded_broadcast(large), "key", "left_semi"))
    pairs = []
    for part in parts:
        dealt = part.select("key", "m", "a", "b", "forward", "word", "n").repartition("key").sortWithinPartitions("m", "key")
        pairs.append(dealt.mapInArrow(_match, "word string, near string, near_n bigint"))
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionByName(more)
    return out.repartition("word").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root: where the forms lead, for words that have one. A form has a larger n, so that no way is a circle."""
    reached = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        further = materialise(reached.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        discard(reached)
        reached = further
        if reached.where("moved").isEmpty():
            return reached.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 6, least_count: int = 5, ratio: int = 5, alter: Alteration | None = None, most: int = MOST) -> DataFrame:
    """One row per word of least_chars code points and least_count occurrences: word, form, root, n, n_near, form_n.

    form: the near word of largest n (of several the first in code-point order) if that is ratio times the word's n or more, else null.
    """
    words = materialise(count_words(docs, id_col, text_col, least_chars, least_count, alter), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = near_pairs(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    has = -F.col("best.less") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, -F.col("best.less")).alias("form_n"),
    )
    rows = materialise(rows, "spelling-forms")
    out = rows.join(roots(rows.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
