"""Substring deduplication with compact windows.

A text is a sequence of shingles of WIDTH words. Under a hash function, the Cartesian tree of the sequence has at each shingle
c the widest window (left, c, right) in which c is least, so all subsequences within it that hold c share the signature value
of c. Only shingles that are least in some stretch of LEAST shingles have windows that long; the tree is built on those,
about 2 / (LEAST + 1) of all. Two texts with a near-duplicate passage share the value of a window in it, under most functions.

1. Each text gives its windows under FUNCTIONS functions. Texts with equal sequences give the same windows and are one node.
2. Nodes are counted by value; a bitmap of bounded size lets only values on that several have, and a few others.
3. All nodes of a value are paired if they are MOST_NODES or fewer. Windows are laid over each other at c; a pair of nodes
   stays if enough functions agree, with the hull of its common intervals. Values of more nodes are hot; a bitmap of bounded
   size tells them. Stretches of LEAST shingles with hot minima get finer keys instead: two to all of their minima, again for
   all pairs up to MOST_NODES, else for stars to the least and greatest node; and the whole stretch, for stars. Nodes that
   have the same stretch so always meet the stretch's hub, which has it too, however frequent parts of it are.
4. Those parts of both texts are compared: stretches in which 8 of 9 shingles are found in the other text, at least LEAST
   long, are cut to what each has of each of the other's, and taken if their Jaccard similarity is 0.8 or more.
5. Stars leave partners out, so each stretch of LEAST shingles that holds such a key, and that no passage found covers, is
   searched for by itself. It can have a partner only if 8 of 9 of its shingles are near such keys of others too (a bitmap of
   bounded size tells); whatever partner it has, has one of its rarest shingles, one more than a ninth. These are compared
   with some nodes that have them, and what is still left with all: of those that can be partners some are verified first, the
   rest if a stretch is open even then. No number of partners is bounded there.
6. A node's stretches are merged, and each of its documents gets them. Equal texts share themselves whole.

Nothing is gathered by node or key beyond MOST_NODES rows: pairs of a hub are dealt to parts of PAIRS, its text with each part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, bounded_broadcast, discard, join_copies, join_groups, materialise, text_chunks
from .exact_dedup import BITMAP_BITS
from .wordscan import _powers as powers
from .wordscan import mix, scan, shingles

WIDTH = 5
#: A passage of 50 words.
LEAST_WORDS = 50
FUNCTIONS = 4
ENOUGH = 2
PERCENT = 80
#: Nodes up to which all nodes of a value are paired with each other.
MOST_NODES = 16
#: Bits of the bitmap that tells hot values, at most; more hot values only mean that more stretches get finer keys.
HOT_BITS = 1 << 27
#: Pairs that share one copy of a node's text.
PAIRS = 256
#: Partners of a probe in a block of that size that are verified first; the others follow if its stretches stay open.
FEW = 4
#: Bytes up to which what is near probes is broadcast.
BLOCK_BYTES = 1 << 25
#: Bytes of text that a kernel takes at once; its arrays are some two hundred times as large.
PIECE_BYTES = 1 << 18


def stretch_minima(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions c of minima of stretches of that length within a text, with the first and last start of c's stretches."""
    n = len(values)
    empty = np.zeros(0, np.int64)
    if n < least:
        return empty, empty, empty
    bits = int(n).bit_length()
    packed = (values >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // least)
    grid = np.full(blocks * least, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = packed
    grid = grid.reshape(blocks, least)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - least + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    start = start[text[start] == text[start + least - 1]]
    at = (np.minimum(after[start], before[start + least - 1]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    runs = np.flatnonzero(new)
    return at[runs], start[runs], start[np.append(runs[1:], len(at)) - 1] if len(at) else empty


def compact_windows(values: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """left, c, right of all compact windows of at least that length, positions in the whole array."""
    c, start, stop = stretch_minima(values, first, least)
    text = np.searchsorted(first, c, side="right") - 1
    low, high = first[text], first[text + 1] - 1
    # Before and after each c the next minimum with a smaller value in its text; -1 without any.
    before, after, stack, now = [-1] * len(c), [-1] * len(c), [-1], -1
    value = [*values[c].tolist(), -1]  # what the stack ends with is the least
    for i, (v, t) in enumerate(zip(value[:-1], text.tolist(), strict=True)):
        if t != now:
            stack, now = [-1], t
        while value[stack[-1]] > v:
            after[stack.pop()] = i
        before[i] = stack[-1]
        stack.append(i)
    # Where c's stretches end because c leaves them, the next smaller value is beyond; it is a minimum itself, or there is none.
    at = np.append(c, 0)
    before, after = np.array(before, np.int64), np.array(after, np.int64)
    left = np.where(start == c - least + 1, np.where(before < 0, low, at[before] + 1), start)
    right = np.where(stop == c, np.where(after < 0, high, at[after] - 1), stop + least - 1)
    return left, c, right


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sequence_keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each text's sequence of shingles; 0 for one without any."""
    place = np.arange(len(values), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values ^ mix(place + np.uint64(1))), out=sums[1:])
    return np.where(np.diff(first) > 0, mix(sums[first[1:]] - sums[first[:-1]]) | np.uint64(1), np.uint64(0))


_WINDOW = "v:bigint,k:int,lo:int,hi:int,before:int,after:int"


def per_text(text: np.ndarray, key: np.ndarray, k: np.ndarray, c: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, ...]:
    """One row for each text and key, in order of texts: text, key, k, first and last c, the most before and after a c."""
    if not len(text):
        return text, key, k, c, c, before, after
    order = np.lexsort((key, text))
    text, key, k, c, before, after = (x[order] for x in (text, key, k, c, before, after))
    at = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1]))))
    return text[at], key[at], k[at], np.minimum.reduceat(c, at), np.maximum.reduceat(c, at), np.maximum.reduceat(before, at), np.maximum.reduceat(after, at)


def _seeded(tokens: np.ndarray, k: int) -> np.ndarray:
    return mix(tokens ^ mix(np.array([k + 1], np.uint64))[0])


def text_windows(docs: DataFrame, width: int, least: int, functions: int) -> DataFrame:
    """__id, __node (key of the shingle sequence), __n (shingles), __windows (all windows of a value as one)."""
    id_type = docs.schema["__id"].dataType.simpleString()
    names = ["v", "k", "lo", "hi", "before", "after"]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, first = shingles(scan(batch.column("__text")), width)
        parts = []
        for k in range(functions):
            values = _seeded(tokens, k)
            left, c, right = compact_windows(values, first, least)
            parts.append((np.searchsorted(first, c, side="right") - 1, values[c], np.full(len(c), k), c, c - left, right - c))
        text, value, k, lo, hi, before, after = per_text(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        base = first[text]
        flat = [pa.array(_signed(value)), *(pa.array(x.astype(np.int32)) for x in (k, lo - base, hi - base, before, after))]
        offsets = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(flat, names))
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(_signed(sequence_keys(tokens, first))), pa.array(np.diff(first)), lists], ["__id", "__node", "__n", "__windows"])

    return arrow_map(docs, "__text", kernel, f"__id {id_type}, __node bigint, __n bigint, __windows array<struct<{_WINDOW}>>", PIECE_BYTES)


def frequent_stretches(docs: DataFrame, hot: np.ndarray, width: int, least: int, functions: int, enough: int) -> DataFrame:
    """Rows like windows, with finer keys, of the stretches of least shingles whose minima are hot by the bitmap.

    Keys of enough minima of one stretch (k 0) if one of them is hot, of more minima if all are; and where fewer than enough aren't hot
    a key of the stretch itself (k 1), so that texts with the same stretch share that key at least.
    """
    sets = [x for n in range(enough, functions + 1) for x in combinations(range(functions), n)]

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, first = shingles(scan(batch.column("__text")), width)
        value, at, is_hot, start = [], [], [], np.zeros(0, np.int64)
        for k in range(functions):
            values = _seeded(tokens, k)
            c, begin, stop = stretch_minima(values, first, least)
            many = stop - begin + 1
            slot = (values[c] >> np.uint64(1)) % np.uint64(8 * len(hot))
            found = (hot[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0
            value.append(np.repeat(values[c], many))
            at.append(np.repeat(c, many))
            is_hot.append(np.repeat(found, many))
            start = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))  # the same for each function
        text = np.searchsorted(first, start, side="right") - 1
        low, high = first[text], first[text + 1] - 1
        n_hot = sum(x.astype(np.int64) for x in is_hot)
        parts = []
        for own in sets:
            count = sum(is_hot[k].astype(np.int64) for k in own)
            on = np.flatnonzero(count == len(own) if len(own) > enough else count > 0)
            # Stretches one after the other with the same minima have one key, from the first to the last of them.
            new = np.ones(len(on), bool)
            new[1:] = np.any([at[k][on[1:]] != at[k][on[:-1]] for k in own], axis=0)
            final = on[np.append(new[1:], True)[: len(on)]]
            on = on[new]
            key = np.full(len(on), sum(1 << k for k in own), np.uint64)
            for k in own:
                key = mix(key ^ value[k][on])
            c = at[own[0]][on]
            # What is near the stretch is looked at too: with changes in it, other minima are.
            before, after = c - np.maximum(low[on], start[on] - least), np.minimum(high[on], start[final] + 2 * least - 1) - c
            parts.append((text[on], key, np.zeros(len(on), np.int64), c, before, after))
        on = np.flatnonzero(n_hot > functions - enough)
        up, down = powers(1 << max(16, len(tokens).bit_length()))
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=sums[1:])
        key = mix((sums[start[on] + least] - sums[start[on]]) * down[start[on]])
        parts.append((text[on], key, np.ones(len(on), np.int64), start[on], np.zeros(len(on), np.int64), np.full(len(on), least - 1)))
        text, key, k, lo, hi, before, after = per_text(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        base, node = first[text], _signed(sequence_keys(tokens, first))
        columns = [node[text], _signed(key), *(x.astype(np.int32) for x in (k, lo - base, hi - base, before, after))]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["a", "v", "k", "lo", "hi", "before", "after"])

    return arrow_map(docs, "__text", kernel, f"a bigint, {_WINDOW.replace(':', ' ').replace(',', ', ')}", PIECE_BYTES)


def _bitmap_size(n: int, each: int) -> int:
    """Bits of a bitmap of n keys, about as many for each key."""
    return min(HOT_BITS, max(BITMAP_BITS, 1 << (each * n).bit_length()))


def _bitmaps(keys: DataFrame, bits: int) -> DataFrame:
    """b and m: the bits of those keys v that have theirs in the b-th BITMAP_BITS of a bitmap of that size."""
    slots = keys.select((F.shiftrightunsigned("v", 1) % bits).alias("s"))
    return slots.groupBy(F.expr(f"s div {BITMAP_BITS}").alias("b")).agg(F.bitmap_construct_agg(F.col("s") % BITMAP_BITS).alias("m"))


def hot_bitmap(large: DataFrame) -> np.ndarray | None:
    """The values (v) of large as bits, HOT_BITS at most; None without any."""
    n = large.count()
    if not n:
        return None
    bits = _bitmap_size(n, 64)
    out = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for r in _bitmaps(large, bits).collect():
        own = np.frombuffer(r["m"], np.uint8)
        out[r["b"], : len(own)] = own
    return out.ravel()


def _repeats(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a key that several nodes have, and a few others; and those keys, with the number of their rows and hubs.

    A bitmap of the keys is sent to the rows, in one pass whatever the input's size. The fuller it is, the more rows of keys of one
    node go on; none of a key of several is left out.
    """
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k"), F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi")
    counts = materialise(counts, f"repeats-{name}-keys")
    bits = _bitmap_size(counts.count(), 16)
    # Numbers of 32 bits are read where they lie; a binary would be copied for each row. The first byte is the highest: hence ^ 24.
    words = f"transform(sequence(0, {BITMAP_BITS // 32 - 1}), i -> coalesce(cast(conv(hex(substring(m, 4 * i + 1, 4)), 16, 10) AS bigint), 0L))"
    bitmap = materialise(_bitmaps(counts, bits).select("b", F.expr(words).alias("m")), f"repeats-{name}-bits")
    slot = f"shiftrightunsigned(v, 1) % {bits}"
    found = rows.withColumn("b", F.expr(f"{slot} div {BITMAP_BITS}")).join(F.broadcast(bitmap), "b")
    found = found.where(f"getbit(m[cast({slot} % {BITMAP_BITS} div 32 AS int)], cast({slot} % 32 ^ 24 AS int)) = 1").select(*rows.columns)
    found = materialise(found, f"repeats-{name}")
    discard(bitmap)
    return found, counts


def _met(pairs: DataFrame) -> DataFrame:
    """k, a, b and the hulls of what their windows have in common, from structs or sides x and y with x.a < y.a."""
    before, after = F.least("x.before", "y.before"), F.least("x.after", "y.after")
    return pairs.select(
        "x.k", F.col("x.a").alias("a"), F.col("y.a").alias("b"), F.greatest(F.lit(0), F.col("x.lo") - before).alias("a0"), (F.col("x.hi") + after).alias("a1"),
        F.greatest(F.lit(0), F.col("y.lo") - before).alias("b0"), (F.col("y.hi") + after).alias("b1"),
    )


_ROW = ("a", "k", "lo", "hi", "before", "after")


def _all_pairs(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Every two nodes of each key that isn't among the large ones."""
    small = rows.join(bounded_broadcast(large.select("v")), "v", "left_anti").select("v", *_ROW)
    return _met(small.alias("x").join(small.alias("y"), F.col("x.v") == F.col("y.v")).where("x.a < y.a"))


def _stars(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Every node of each of these keys with the key's least and greatest node."""
    hubs = large.select("v", F.col("lo").alias("a")).unionByName(large.select("v", F.col("hi").alias("a")))
    at = rows.join(bounded_broadcast(hubs), ["v", "a"]).select("v", F.struct(*_ROW).alias("h"))
    both = rows.select("v", F.struct(*_ROW).alias("w")).join(bounded_broadcast(at), "v").where("w.a != h.a")
    return _met(both.select(F.least("w", "h").alias("x"), F.greatest("w", "h").alias("y")))


def _hull() -> list[Column]:
    return [F.min("a0").alias("a0"), F.max("a1").alias("a1"), F.min("b0").alias("b0"), F.max("b1").alias("b1")]


def candidate_pairs(texts: DataFrame, docs: DataFrame, width: int, least: int, functions: int, enough: int, most: int = MOST_NODES) -> tuple[DataFrame, DataFrame | None]:
    """a, b (nodes) and the hulls a0..a1, b0..b1 of what their windows have in common, if enough functions agree; and the rows
    v, a, lo, hi of keys of minima that were only paired by stars, of which open_probes and probed_pairs find the other partners.

    Of equal texts one is enough, in texts and in docs; more of them only make a key look more frequent.
    """
    windows = texts.select(F.col("__node").alias("a"), F.explode("__windows").alias("w")).select("a", "w.*")
    rows, counts = _repeats(windows, "windows")
    large = counts.where(F.col("n") > most)
    agree = _all_pairs(rows, large).groupBy("a", "b").agg(F.expr("bit_or(shiftleft(1, k))").alias("ks"), *_hull()).where(F.bit_count("ks") >= enough).drop("ks")
    pairs = materialise(agree, "repeats-pairs")
    hot = hot_bitmap(large)
    discard(rows, counts)
    if hot is None:
        return pairs, None
    finer = materialise(frequent_stretches(docs, hot, width, least, functions, enough), "repeats-frequent")
    rows, counts = _repeats(finer, "stretches")
    discard(finer)
    # A stretch's own key needs no more than a hub: whatever node has the key has the stretch.
    large = materialise(counts.where((F.col("k") == 1) | (F.col("n") > most)), "repeats-large")
    both = materialise(pairs.unionByName(_all_pairs(rows, large).unionByName(_stars(rows, large)).drop("k")).groupBy("a", "b").agg(*_hull()), "repeats-pairs")
    starred = materialise(rows.join(bounded_broadcast(large.where("k = 0").select("v")), "v", "left_semi").select("v", "a", "lo", "hi"), "repeats-starred")
    discard(pairs, rows, counts, large)
    return both, starred


def _lookup(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key's bit is set in a bitmap of keys."""
    slot = (keys >> np.uint64(1)) % np.uint64(8 * len(bits))
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def _runs(on: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values, from and to (exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _spread(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals lo to hi, both included."""
    steps = np.zeros(n + 1, np.int64)
    lo, hi = np.clip(lo, 0, n), np.clip(hi + 1, 0, n)
    np.add.at(steps, lo[lo < hi], 1)
    np.add.at(steps, hi[lo < hi], -1)
    return np.cumsum(steps)[:n] > 0


def starred_parts(starred: DataFrame, tokens: DataFrame, least: int) -> DataFrame:
    """a, base, own (shingles from base on) and at (the keys' shingles in them) of all parts up to 2 * least from a key paired by stars."""
    places = starred.groupBy("a").agg(F.collect_set("lo").alias("at"))
    joined = tokens.join(places, tokens["__node"] == places["a"]).select("a", "at", "__tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in text_chunks(whole, "__tokens")):
            out = []
            for node, at, raw in zip(*(batch.column(c) for c in ("a", "at", "__tokens")), strict=True):
                own = np.frombuffer(raw.as_buffer(), "<u4")
                # A key's shingle is the same wherever the node has the key.
                places = np.flatnonzero(np.isin(own, own[at.values.to_numpy()]))
                for x, y in _runs(_spread(len(own), places - 2 * least, places + 2 * least)):
                    inside = places[(places >= x) & (places < y)]
                    out.append((node.as_py(), x, own[x:y].tobytes(), (inside - x).tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["a", "base", "own", "at"])

    return materialise(joined.mapInArrow(run, "a bigint, base int, own binary, at array<int>"), "repeats-parts")


def frequency_bitmaps(parts: DataFrame, most: int) -> Broadcast[list[np.ndarray]]:
    """Bitmaps of the shingles that more than 1 and more than most of the parts have, and of others that share their bits. Sent out once."""
    n = parts.agg(F.sum(F.length("own"))).first()[0] or 0
    bits = min(HOT_BITS, max(BITMAP_BITS, 1 << (4 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column("own"):
                keys = np.unique(np.frombuffer(own.as_buffer(), "<u4")).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((keys >> 1) % bits)], ["s"])

    counts = parts.select("own").mapInArrow(run, "s bigint").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    levels = (1, most)
    maps = [F.bitmap_construct_agg(F.when(F.col("n") > x, F.col("s") % BITMAP_BITS)).alias(f"m{i}") for i, x in enumerate(levels)]
    out = [np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8) for _ in levels]
    for r in counts.groupBy(F.expr(f"s div {BITMAP_BITS}").alias("b")).agg(*maps).collect():
        for i, m in enumerate(out):
            own = np.frombuffer(r[f"m{i}"], np.uint8)
            m[r["b"], : len(own)] = own
    return parts.sparkSession.sparkContext.broadcast([m.ravel() for m in out])


_PROBE = "x bigint, a bigint, base int, cut binary, open binary"


def _probe_rows(found: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], far: int) -> pa.RecordBatch:
    """x, a, base, cut, open from a part's node, base, shingles, wanted places and begins of open stretches.

    cut is what is up to far from an x, 16 bits of each shingle, open the begins in it.
    """
    rows = []
    for node, base, own, where, begin in found:
        short = own.astype("<u2")
        order = where[np.argsort(own[where], kind="stable")]
        edges = np.flatnonzero(np.concatenate(([True], np.diff(own[order].astype(np.int64)) != 0, [True]))) if len(where) else [0]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            lo, hi = max(0, int(order[i]) - far), int(order[j - 1]) + far + 1
            inside = begin[np.searchsorted(begin, lo) : np.searchsorted(begin, hi)] - lo
            rows.append((int(own[order[i]]), node, base + lo, short[lo:hi].tobytes(), inside.astype("<i4").tobytes()))
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["x", "a", "base", "cut", "open"])


def _bounds(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least height of a mark up to each place, and the greatest after a mark from each place on; marks count 1, others -8.

    A stretch that begins and ends with marks and has 8 of 9 goes from one to another that isn't lower.
    """
    height = np.cumsum(np.where(marks, np.int32(1), np.int32(-8)), axis=0, dtype=np.int32)
    far = np.int32(1 << 30)
    low = np.minimum.accumulate(np.where(marks, height - 1, far), axis=0)
    return low, np.maximum.accumulate(np.where(marks, height, -far)[::-1], axis=0)[::-1]


def _dense(own: np.ndarray, bitmaps: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """How frequent each shingle is (0: no other part has it), and which stretches of least have 8 of 9 that others have too."""
    keys = own.astype(np.uint64)
    level = sum(_lookup(m, keys).astype(np.uint64) for m in bitmaps)
    sums = np.concatenate(([0], np.cumsum(level > 0)))
    return level, sums[least:] - sums[:-least] >= -(-8 * least // 9)


def open_probes(parts: DataFrame, found: DataFrame, bitmaps: Broadcast[list[np.ndarray]], least: int) -> DataFrame:
    """x, a and what is near x: shingles that tell every partner of the stretches that hold a starred key and aren't in a passage found.

    A partner has 8 of 9 shingles of such a stretch, so at least one of any of its ninth and one more: the rarest ones are taken.
    A stretch that has more than a ninth of shingles that nothing else has can have no partner.
    """
    rare = least + 1 - -(-8 * least // 9)
    joined = parts.join(merged(found).withColumnRenamed("__node", "a").select("a", "__passages"), "a", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in text_chunks(whole, "own", PIECE_BYTES)):
            out = []
            for node, base, raw, at, spans in zip(*(batch.column(c) for c in ("a", "base", "own", "at", "__passages")), strict=True):
                own, base, at = np.frombuffer(raw.as_buffer(), "<u4"), base.as_py(), at.values.to_numpy().astype(np.int64)
                if len(own) < least:
                    continue
                level, dense = _dense(own, bitmaps.value, least)
                left, known = dense & _spread(len(dense), at - least + 1, at), np.zeros(len(own), bool)
                if spans.is_valid:
                    lo, hi = (spans.values.field(c).to_numpy() - base for c in ("__from", "__to"))
                    left &= ~_spread(len(dense), lo, hi - least)
                    known = _spread(len(own), lo, hi - 1)
                # A passage begins and ends with a shingle that its partner has.
                first, last = ((level > 0)[x : x + len(dense)] for x in (0, least - 1))
                ends = (first & ~known[: len(dense)]) | (last & ~known[least - 1 :]) | (first & last)
                low, high = _bounds(level > 0)
                begin = np.flatnonzero(left & ends & (low[: len(dense)] <= high[least - 1 :]))
                order = (level << np.uint64(56)) | (mix(own.astype(np.uint64)) >> np.uint64(8))
                wanted = np.zeros(len(own), bool)
                for i in range(0, len(begin), 4096):
                    some = begin[i : i + 4096, None]
                    wanted[np.argpartition(order[some + np.arange(least)], rare - 1, axis=1)[:, :rare] + some] = True
                where = np.flatnonzero(wanted & (level > 0))
                out.append((node.as_py(), base, own, where, begin))
            yield _probe_rows(out, 2 * least)

    return materialise(joined.mapInArrow(run, _PROBE), "repeats-probes")


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """x and lists of about PAIRS of its rows at most."""
    many = rows.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("__parts")).where("__parts > 1")
    dealt = rows.join(bounded_broadcast(materialise(many, "parts")), "x", "left")
    part = F.coalesce(F.pmod(F.xxhash64("a", "base"), F.col("__parts")), F.lit(0)).alias("__part")
    return dealt.groupBy("x", part).agg(F.collect_list(F.struct("a", "base", "cut", "open")).alias(name)).select("x", name)


def partners(cuts: list[np.ndarray], begins: list[np.ndarray], others: list[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """For each of the cuts (16-bit shingles) those of the others that have 8 of 9, the first and last too, of what holds a stretch that begins there."""
    flat, of = np.concatenate(others), np.repeat(np.arange(len(others)), [len(x) for x in others])
    place = np.full(1 << 16, -1, np.int32)
    for own, begin in zip(cuts, begins, strict=True):
        kinds, number = np.unique(own, return_inverse=True)
        place[kinds] = np.arange(len(kinds))
        at = place[flat]
        hit = np.flatnonzero(at >= 0)
        has = np.zeros((len(kinds), len(others)), bool)
        has[at[hit], of[hit]] = True
        place[kinds] = -1
        low, high = _bounds(has[number])
        begin = begin[begin + least <= len(own)]
        yield np.flatnonzero((low[begin] <= high[begin + least - 1]).any(axis=0))


def probed_pairs(parts: DataFrame, probes: DataFrame, bitmaps: Broadcast[list[np.ndarray]], least: int, hubs: int | None) -> DataFrame:
    """Pairs like candidate_pairs of each probe's node and every node that has its shingle and 8 of 9 of a stretch with it.

    of: the probe's node, a or b. few: whether b, or a, is among the first FEW that a probe finds in a block, as the nodes of an
    open stretch lie in several blocks if they are many. With hubs, only so many of a shingle's nodes are taken.
    """
    asked = hot_bitmap(probes.select(F.col("x").alias("v")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in text_chunks(whole, "own", PIECE_BYTES)):
            out = []
            for node, base, raw in zip(*(batch.column(c) for c in ("a", "base", "own")), strict=True):
                own = np.frombuffer(raw.as_buffer(), "<u4")
                if len(own) >= least and _dense(own, bitmaps.value, least)[1].any():
                    out.append((node.as_py(), base.as_py(), own, np.flatnonzero(_lookup(asked, own.astype(np.uint64))), np.zeros(0, np.int64)))
            yield _probe_rows(out, 2 * least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column("p"), batch.column("q"), strict=True):
                nodes, bases = ([x.values.field(c).to_pylist() for x in (left, right)] for c in ("a", "base"))
                cuts = [[np.frombuffer(z.as_buffer(), "<u2") for z in x.values.field("cut")] for x in (left, right)]
                begins = [np.frombuffer(z.as_buffer(), "<i4") for z in left.values.field("open")]
                rows = []
                for i, found in enumerate(partners(cuts[0], begins, cuts[1], least)):
                    a, x = nodes[0][i], (bases[0][i], bases[0][i] + len(cuts[0][i]) - 1)
                    for n, j in enumerate(found.tolist()):
                        b, y = nodes[1][j], (bases[1][j], bases[1][j] + len(cuts[1][j]) - 1)
                        if a != b:
                            rows.append((a, b, *x, *y, a, n < FEW) if a < b else (b, a, *y, *x, a, n < FEW))
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "a0", "a1", "b0", "b1", "of", "few"])

    there = parts.mapInArrow(run, _PROBE)
    if hubs:
        there = there.groupBy("x", F.pmod(F.xxhash64("a"), F.lit(hubs)).alias("i")).agg(F.min(F.struct("a", "base", "cut", "open")).alias("w")).select("x", "w.*")
    there = materialise(there, "repeats-there")
    asking, small = _blocks(probes, "p"), (probes.agg(F.sum(F.length("cut"))).first()[0] or 0) <= BLOCK_BYTES
    both = _blocks(there, "q").join(F.broadcast(asking) if small else asking, "x")
    met = both.select("p", "q").mapInArrow(compare, "a bigint, b bigint, a0 int, a1 int, b0 int, b1 int, of bigint, few boolean")
    pairs = materialise(met.groupBy("a", "b", "of").agg(*_hull(), F.max("few").alias("few")), "repeats-asked")
    discard(there)
    return pairs


def _longest(found: np.ndarray, least: int) -> tuple[int, int]:
    """The longest stretch with 8 matches of 9 or more, from and to (exclusive); (0, 0) if it is shorter than least."""
    height = np.zeros(len(found) + 1, np.int64)
    (9 * found.astype(np.int64) - 8).cumsum(out=height[1:])
    falls = np.minimum.accumulate(height)
    if not (falls[: len(falls) - least] <= height[least:]).any():
        return 0, 0
    low = np.ones(len(falls), bool)
    np.less(falls[1:], falls[:-1], out=low[1:])
    starts = low.nonzero()[0]
    peaks = np.maximum.accumulate(height[::-1])[::-1]
    # For each new low, the last point that isn't lower.
    ends = (-peaks).searchsorted(-height[starts], side="right") - 1
    best = int((ends - starts).argmax())
    return int(starts[best]), int(ends[best])


def _stretches(found: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Disjoint stretches with 8 matches of 9 or more that begin and end with a match, the longest first, then those beside it."""
    if found.all():
        return [(0, len(found))] if len(found) >= least else []
    out, todo, enough = [], [(0, len(found))], -(-8 * least // 9)
    while todo:
        lo, hi = todo.pop()
        if hi - lo < least or np.count_nonzero(found[lo:hi]) < enough:
            continue
        x, y = _longest(found[lo:hi], least)
        if y - x < least:
            continue
        inside = found[lo + x : lo + y].nonzero()[0]
        x, y = lo + x + int(inside[0]), lo + x + int(inside[-1]) + 1
        if y - x >= least:
            out.append((x, y))
        todo += [(lo, x), (y, hi)]
    return out


def _widest_gap(found: np.ndarray) -> tuple[int, int]:
    """The longest run without a match, from and to (exclusive)."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], ~found, [0]))))
    k = int((edges[1::2] - edges[::2]).argmax())
    return int(edges[2 * k]), int(edges[2 * k + 1])


def _kinds(values: np.ndarray) -> int:
    """How many different values there are."""
    values = np.sort(values)
    return np.count_nonzero(values[1:] != values[:-1]) + min(1, len(values))


#: Used by one call at a time, and left empty.
_SHORT = np.zeros(1 << 16, bool)


def may_have_passages(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    """False only if no stretch of a has 8 of 9 shingles in b: told by 16 bits of each, which can only add matches."""
    if min(len(a), len(b)) < least:
        return False
    _SHORT[short := b.astype("<u2")] = True
    found = _SHORT[a.astype("<u2")]
    _SHORT[short] = False
    if np.count_nonzero(found) < -(-8 * least // 9):
        return False
    height = np.zeros(len(found) + 1, np.int64)
    (9 * found.astype(np.int64) - 8).cumsum(out=height[1:])
    return bool((np.minimum.accumulate(height[: len(found) - least + 1]) <= height[least:]).any())


def common_passages(a: np.ndarray, b: np.ndarray, least: int, percent: int) -> list[tuple[int, int, int, int]]:
    """Near-duplicate stretches (a from, a to, b from, b to, ends exclusive) of two shingle sequences.

    Stretches of a that are found in b, and of b that are found in those, are cut to what they have in common until nothing
    changes; two that still differ too much are cut at their widest gap. All stretches of b count for each one of a.
    """
    if not may_have_passages(a, b, least):
        return []
    kinds, number = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b = number[: len(a)], number[len(a) :]
    marks = np.zeros(len(kinds), bool)

    def among(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        marks[y] = True
        found = marks[x]
        marks[y] = False
        return found

    out: list[tuple[int, int, int, int]] = []
    known: dict[bytes, list[tuple[int, int, int, int]]] = {}
    for x0, y0 in _stretches(among(a, b), least):
        key = a[x0:y0].tobytes()
        if key not in known:  # a passage that a has often is looked for once
            pieces, todo = [], [(x0, y0, 0, len(b))]
            while todo:
                x, y, u, v = todo.pop()
                of_a, of_b = among(a[x:y], b[u:v]), among(b[u:v], a[x:y])
                parts = _stretches(of_b, least)
                if parts != [(0, v - u)]:
                    todo += [(x, y, u + i, u + j) for i, j in parts]
                    continue
                parts = _stretches(of_a, least)
                if parts != [(0, y - x)]:
                    todo += [(x + i, x + j, u, v) for i, j in parts]
                    continue
                left, right = a[x:y], b[u:v]
                if y - x == v - u and (left == right).all():
                    pieces.append((x - x0, y - x0, u, v))
                    continue
                union = _kinds(np.concatenate((left, right)))
                both = _kinds(left) + _kinds(right) - union
                if 100 * both >= percent * union:
                    pieces.append((x - x0, y - x0, u, v))
                elif not of_a.all():
                    i, j = _widest_gap(of_a)
                    todo += [(x, x + i, u, v), (x + j, y, u, v)]
                else:
                    i, j = _widest_gap(of_b)
                    todo += [(x, y, u, u + i), (x, y, u + j, v)]
            known[key] = pieces
        out += [(x0 + i, x0 + j, u, v) for i, j, u, v in known[key]]
    return out


def node_tokens(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """__node, __rep (the id of one of its documents) and __tokens (its shingles, 32 bits each) of the wanted nodes (__node); before it the stored rows."""
    holders = nodes.join(bounded_broadcast(wanted), "__node", "left_semi").select(F.col("__lo").alias("__rep")).distinct()
    own = docs.join(bounded_broadcast(materialise(holders, "repeats-holders")), docs["__id"].eqNullSafe(F.col("__rep")), "left_semi")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokens, first = shingles(scan(batch.column("__text")), width)
        raw = (tokens >> np.uint64(32)).astype("<u4").tobytes()
        data = [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(_signed(sequence_keys(tokens, first))), batch.column("__id"), pa.array(data, pa.binary())], ["__node", "__rep", "__tokens"])

    # Rows whose id is that of another node's holder are no harm; equal rows are one. Texts are not shuffled for that.
    id_type = docs.schema["__id"].dataType.simpleString()
    held = arrow_map(own, "__text", kernel, f"__node bigint, __rep {id_type}, __tokens binary").withColumn("__row", F.monotonically_increasing_id())
    held = materialise(held, "repeats-tokens")
    best = held.groupBy("__node").agg(F.min(F.struct("__rep", "__row")).alias("__best"))
    kept = bounded_broadcast(materialise(best.select(F.col("__best.__row").alias("__row")), "repeats-rows"))
    return held, held.join(kept, "__row", "left_semi").drop("__row")


def _beside(pairs: DataFrame, tokens: DataFrame, x: str, counted: DataFrame) -> DataFrame:
    """pairs with t<x>, the part of node x that is to be compared, and r<x>, its document. Nodes in many pairs have several copies of their text."""
    cut = F.expr(f"substring(__tokens, cast(4 * {x}0 + 1 as int), cast(4 * ({x}1 - {x}0 + 1) as int))")
    joined = join_copies(pairs, tokens.withColumnRenamed("__node", x), x, F.xxhash64("a", "b"), PAIRS, counted)
    return joined.select(*pairs.columns, cut.alias(f"t{x}"), F.col("__rep").alias(f"r{x}"))


def verified(pairs: DataFrame, tokens: DataFrame, least: int, percent: int, narrow: bool = False) -> DataFrame:
    """__node, __from, __to (shingles, end exclusive), __partner (a document) of confirmed stretches, for both sides of each pair.

    narrow: only some of the nodes are in pairs, so that the others' texts need not be shuffled.
    """
    id_type = tokens.schema["__rep"].dataType.simpleString()
    if narrow:
        nodes = bounded_broadcast(materialise(pairs.select(F.explode(F.array("a", "b")).alias("__node")).distinct(), "repeats-compared"))
        tokens = tokens.join(nodes, "__node", "left_semi")
    joined = _beside(_beside(pairs, tokens, "a", pairs), tokens, "b", pairs).select("a", "b", "a0", "b0", "ta", "tb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_chunks(whole, "ta"):
                rows, origin = [], []
                for i, (a, b, a0, b0, ta, tb) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a0", "b0", "ta", "tb")), strict=True)):
                    found = common_passages(np.frombuffer(ta, "<u4"), np.frombuffer(tb, "<u4"), least, percent)
                    own = {(a, a0 + x, a0 + y) for x, y, _, _ in found}
                    other = {(b, b0 + u, b0 + v) for _, _, u, v in found}
                    rows += [*own, *other]
                    origin += [(i, "rb")] * len(own) + [(i, "ra")] * len(other)
                cols = list(zip(*rows, strict=True)) or [[]] * 3
                ids = {c: batch.column(c).to_pylist() for c in ("ra", "rb")}
                partner = pa.array([ids[c][i] for i, c in origin], batch.schema.field("ra").type)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), partner], ["__node", "__from", "__to", "__partner"])

    found = joined.mapInArrow(run, f"__node bigint, __from bigint, __to bigint, __partner {id_type}")
    return found.groupBy("__node", "__from", "__to").agg(F.min("__partner").alias("__partner"))


def merged(spans: DataFrame) -> DataFrame:
    """__node and its __passages: stretches that touch are one, with the least partner."""
    order = Window.partitionBy("__node").orderBy("__from", "__to")
    edge = F.coalesce(F.max("__to").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = spans.withColumn("__new", (F.col("__from") > edge).cast("int")).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = islands.groupBy("__node", "__island").agg(F.min("__from").alias("__from"), F.max("__to").alias("__to"), F.min("__partner").alias("__partner"))
    return whole.groupBy("__node").agg(F.collect_list(F.struct("__from", "__to", "__partner")).alias("__passages"))


def repeated_passages(docs: DataFrame, least_words: int = LEAST_WORDS, width: int = WIDTH, functions: int = FUNCTIONS, enough: int = ENOUGH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_NODES) -> DataFrame:
    """One row per document and passage that it shares with another document: id, start_word, end_word (exclusive), n_words, shared_with.

    shared_with is the id of a document that has the passage. Passages that touch are one. Documents without a repeated passage, null,
    empty and short texts have no row. Rows that are equal in id and text are one document. Null ids take part and come out as null.
    most: nodes up to which all of a key are paired at once; it sets the way, not the result.
    An empty table gives no rows. Other columns are not carried.
    """
    least = max(1, least_words - width + 1)
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    texts = materialise(text_windows(narrow, width, least, functions).where(F.col("__n") >= least), "repeats-texts")
    members = materialise(texts.select("__id", "__node", "__n").distinct(), "repeats-members")
    nodes = materialise(members.groupBy("__node").agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi"), F.max("__n").alias("__n"), F.count(F.lit(1)).alias("__docs")), "repeats-nodes")
    # Equal texts are looked at once: rows go whose id is no node's least.
    groups = nodes.where("__docs > 1").select("__node", "__lo", "__docs")
    again = join_groups(members.select("__id", "__node"), groups, "__node", "__docs", members.count()).where("__id != __lo").select("__id").distinct()
    again = materialise(again.join(nodes.select(F.col("__lo").alias("__id")), "__id", "left_anti"), "repeats-again")
    first = [df.join(bounded_broadcast(again), "__id", "left_anti") for df in (texts, narrow)]
    pairs, starred = candidate_pairs(*first, width, least, functions, enough, most)
    discard(texts, again)
    wanted = pairs.select(F.col("a").alias("__node")).union(pairs.select("b"))
    stored, tokens = node_tokens(narrow, nodes, wanted.distinct(), width)
    found = materialise(verified(pairs, tokens, least, percent), "repeats-found")
    if starred is not None:
        parts = starred_parts(starred, tokens, least)
        bitmaps = frequency_bitmaps(parts, most)

        def also(asked: DataFrame) -> DataFrame:
            more = materialise(asked.groupBy("a", "b").agg(*_hull()), "repeats-pairs")
            out = materialise(found.unionByName(verified(more, tokens, least, percent, narrow=True)), "repeats-found")
            discard(more)
            return out

        # Some partners for all first, then all partners for what these leave. Passages only close stretches, so that nodes that ask
        # nothing now ask nothing later.
        asking = parts
        for hubs in (most, None):
            probes = open_probes(asking, found, bitmaps, least)
            if probes.isEmpty():
                break
            asking = parts.join(bounded_broadcast(materialise(probes.select("a").distinct(), "repeats-open")), "a", "left_semi")
            more = probed_pairs(parts, probes, bitmaps, least, hubs)
            found = also(more if hubs else more.where("few"))
            rest = more.where("not few")
            if not hubs and not rest.isEmpty():
                asking = parts.join(bounded_broadcast(materialise(rest.select(F.col("of").alias("a")).distinct(), "repeats-open")), "a", "left_semi")
                still = materialise(open_probes(asking, found, bitmaps, least).select(F.col("a").alias("of")).distinct(), "repeats-open")
                found = also(rest.join(bounded_broadcast(still), "of", "left_semi"))
            discard(probes, more)
        bitmaps.destroy()
        discard(parts, starred)
    copies = nodes.where("__docs > 1").select("__node", F.lit(0).cast("bigint").alias("__from"), F.col("__n").alias("__to"), F.lit(None).cast(found.schema["__partner"].dataType).alias("__partner"))
    passages = merged(found.unionByName(copies)).join(nodes.select("__node", "__lo", "__hi", "__docs"), "__node")
    passages = materialise(passages, "repeats-passages")
    discard(stored, pairs)
    out = join_groups(members.select("__id", "__node"), passages, "__node", "__docs", members.count()).select("*", F.explode("__passages").alias("__p"))
    words = F.col("__p.__to") + (width - 1)
    other = F.coalesce(F.col("__p.__partner"), F.when(F.col("__id").eqNullSafe(F.col("__lo")), F.col("__hi")).otherwise(F.col("__lo")))
    return out.select(F.col("__id").alias(id_col), F.col("__p.__from").alias("start_word"), words.alias("end_word"), (words - F.col("__p.__from")).alias("n_words"), other.alias("shared_with"))
