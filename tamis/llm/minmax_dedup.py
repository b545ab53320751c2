"""Near-duplicate components by min-max hashing.

Each of ``permutations`` hash functions is evaluated once over a document's distinct shingles and gives two signature
values, the least and the greatest; both agree for two documents with a probability equal to their Jaccard similarity.
Values are cut into bands of ``rows``; documents that agree on a band are candidates. With 75 functions and bands of 5,
30 bands, a pair at similarity 0.8 is missed with a probability of 7 in a million, a more similar one with less.

1. Documents with equal shingle sets are one class (a group of any size is reduced map side).
2. Classes of a band that MOST_CLASSES or fewer have are candidate pairs. Those of larger bands are dense: they may be copies, or
   texts that only share frequent words. Dense classes are paired again by their rarest shingles, so many that two sets
   similar enough must have one of them in common (a prefix filter; no pair that could link is lost).
   Shingles that many classes have among their rarest make families.
3. Candidate pairs are confirmed on full sets: clusters that fit into a block by the products of shingle incidence matrices, in
   one task each; pairs of larger clusters pair by pair, so that a long chain costs no more than its pairs.
4. Families are cut into blocks of bounded size, by size of set. Each block is compared with about HUBS classes of its family;
   only classes that those did not bring into one component are compared with all blocks whose sizes allow a link.
5. Components of the links found are the documents' components. Tasks give spanning stars of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_map, bounded_broadcast, discard, join_copies, join_groups, materialise, release_memory
from .components import components
from .wordscan import distinct, mix, scan, shingles

PERMUTATIONS = 75
ROWS = 5
#: Shingles in a block, and the documents it may have at most.
BLOCK_SHINGLES = 150_000
BLOCK_DOCS = 512
#: Classes up to which all of a band are pairs, classes of a family that all others are compared with, pairs that share one copy of a set.
MOST_CLASSES = 16
HUBS = 8
PAIRS = 256
#: Slots in which the frequency of shingles is counted, to tell which are rare. Shingles in one slot only make the filter coarser.
SLOTS = 1 << 20


def multipliers(n: int) -> np.ndarray:
    """Odd multipliers, one for each hash function."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(values: np.ndarray, first: np.ndarray, permutations: int) -> np.ndarray:
    """Least and greatest value under each function, for each (not empty) set: an array of sets by 2 * permutations."""
    out = np.empty((len(first) - 1, 2 * permutations), np.uint64)
    for k, a in enumerate(multipliers(permutations)):
        hashed = values * a
        out[:, 2 * k] = np.minimum.reduceat(hashed, first[:-1])
        out[:, 2 * k + 1] = np.maximum.reduceat(hashed, first[:-1])
    return out


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each set."""
    n = signature.shape[1] // rows
    keys = np.tile(mix(np.arange(1, n + 1, dtype=np.uint64)), (len(signature), 1))
    for j in range(rows):
        keys = mix(keys ^ signature[:, j : n * rows : rows])
    return keys


def set_keys(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of each (not empty) set."""
    return np.add.reduceat(mix(values), first[:-1]), np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first[:-1])


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def sketch(docs: DataFrame, width: int, permutations: int, rows: int) -> DataFrame:
    """id, __n (distinct shingles), and unless that is 0 the set's keys __k1, __k2 and its bands."""
    id_type = docs.schema["__id"].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = distinct(*shingles(scan(batch.column("__text")), width))
        n = np.diff(first)
        full = n > 0
        k1 = k2 = np.zeros(0, np.uint64)
        keys = np.zeros((0, 2 * permutations // rows), np.uint64)
        if full.any():
            starts = np.concatenate((first[:-1][full], first[-1:]))
            k1, k2 = set_keys(values, starts)
            keys = bands(signatures(values, starts, permutations), rows)

        def spread(x: np.ndarray) -> pa.Array:
            out = np.zeros(len(n), np.int64)
            out[full] = _signed(x)
            return pa.array(out, mask=~full)

        sizes = np.where(full, keys.shape[1], 0)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(_signed(keys).ravel()))
        return pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(n), spread(k1), spread(k2), lists], ["__id", "__n", "__k1", "__k2", "__bands"])

    return arrow_map(docs, "__text", kernel, f"__id {id_type}, __n bigint, __k1 bigint, __k2 bigint, __bands array<bigint>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """The key __k1 and the sorted distinct shingles, as bytes, of each document that has any."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, first = distinct(*shingles(scan(batch.column("__text")), width))
        full = np.diff(first) > 0
        starts = np.concatenate((first[:-1][full], first[-1:]))
        k1 = set_keys(values, starts)[0] if full.any() else np.zeros(0, np.uint64)
        raw = values.astype("<u8").tobytes()
        sets = [raw[8 * a : 8 * b] for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(_signed(k1)), pa.array(sets, pa.binary())], ["__k1", "__set"])

    return arrow_map(docs, "__text", kernel, "__k1 bigint, __set binary")


def links_of_block(nodes: list[int], sides: list[int], sets: list[bytes | pa.Buffer], percent: int) -> list[tuple[int, int]]:
    """Stars (node, root) that span the links among the sets; with two sides, of those between them."""
    by_node = dict(zip(nodes, zip(sides, sets, strict=True), strict=True))
    nodes = sorted(by_node)
    side = np.array([by_node[x][0] for x in nodes])
    arrays = [np.frombuffer(by_node[x][1], "<u8") for x in nodes]
    n = np.array([len(x) for x in arrays])
    m = len(nodes)
    if m < 2:
        return []
    row = np.repeat(np.arange(m), n)
    _, column, many = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    shared = many > 1  # what one set alone has, no intersection has
    renumber = np.cumsum(shared) - 1
    row, column = row[shared[column]], renumber[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((m, m), np.float32)  # counts stay exact below 2**24; larger ones only with as many shingles in a document
    if n.max() >= 1 << 24:
        common = common.astype(np.float64)
    step = max(64, (4 << 20) // m)
    for a in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, (a, a + step))
        part = np.zeros((m, step), common.dtype)
        part[row[lo:hi], column[lo:hi] - a] = 1
        common += part @ part.T
    linked = (100 + percent) * common >= percent * (n[:, None] + n[None, :])
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    root = np.full(m, -1)
    out = []
    for i in range(m):
        if root[i] < 0 and linked[i].any():
            root[i], front = i, [i]
            while front:
                found = linked[front].any(axis=0) & (root < 0)
                front = np.flatnonzero(found).tolist()
                root[front] = i
                out += [(nodes[j], nodes[i]) for j in front]
    return out


def compare_blocks(tasks: DataFrame, percent: int) -> DataFrame:
    """Links a, b among rows (__task, __side, __k1, __set); a task's rows lie together and are taken one task at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, found = None, [], []

        def close() -> None:
            if len(rows) > 1:
                found.extend(links_of_block(*(list(x) for x in zip(*rows, strict=True)), percent))
            rows.clear()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])
            found.clear()
            return out

        for batch in batches:
            for task, side, node, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if task != now:
                    close()
                    now = task
                rows.append((node, side, data.as_buffer()))  # not copied
            if len(found) > 10_000:
                yield flush()
        close()
        yield flush()
        release_memory()

    laid = tasks.repartition("__task").sortWithinPartitions("__task").select("__task", "__side", "__k1", "__set")
    return laid.mapInArrow(run, "a bigint, b bigint")


def shingle_slots(sets: DataFrame) -> np.ndarray:
    """Sets that have a shingle in each slot, at least: SLOTS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for raw in batch.column("__set"):
                np.add.at(total, (np.frombuffer(raw.as_buffer(), "<u8") & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    counts = sets.select("__set").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    return out


def prefixes(sets: DataFrame, frequency: np.ndarray, percent: int) -> DataFrame:
    """__shingle, a (class), n (size): of each set of n the n - least + 1 rarest shingles, least being what a partner must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, values, sizes = [], [], []
            for node, raw in zip(batch.column("__k1").to_pylist(), batch.column("__set"), strict=True):
                own = np.frombuffer(raw.as_buffer(), "<u8")
                least = -(-percent * len(own) // 100)
                rank = np.lexsort((own, frequency[(own & np.uint64(SLOTS - 1)).astype(np.int64)]))
                values.append(own[rank[: len(own) - least + 1]])
                nodes.append(node)
                sizes.append(len(own))
            many = [len(x) for x in values]
            data = _signed(np.concatenate(values)) if values else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(data), pa.array(np.repeat(np.array(nodes, np.int64), many)), pa.array(np.repeat(np.array(sizes, np.int64), many))], ["__shingle", "a", "n"])

    return sets.select("__k1", "__set").mapInArrow(run, "__shingle bigint, a bigint, n bigint")


def _groups(rows: DataFrame, key: str, total: int, name: str) -> DataFrame:
    """rows (key, a, n; total of them) of keys that several classes have, with the number __m of rows."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__m"), F.min("a").alias("__lo"), F.max("a").alias("__hi")).where("__lo < __hi").drop("__lo", "__hi")
    counts = materialise(counts, f"{name}-counts")
    out = materialise(join_groups(rows, counts, key, "__m", total, BROADCAST_ROWS), name)
    discard(counts)
    return out


def _pairs(groups: DataFrame, key: str, percent: int) -> DataFrame:
    """a, b: every two classes of each key that MOST_CLASSES or fewer have, if their sizes allow a link."""
    lists = groups.where(F.col("__m") <= MOST_CLASSES).groupBy(key).agg(F.collect_set(F.struct("a", "n")).alias("all"))
    both = lists.select("all", F.explode("all").alias("x")).select("x", F.explode("all").alias("y")).where("x.a < y.a")
    return both.where(f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)").select(F.col("x.a").alias("a"), F.col("y.a").alias("b"))


def _stars(groups: DataFrame, key: str) -> DataFrame:
    """a, b: the classes of each key that more have, with the least one."""
    large = groups.where(F.col("__m") > MOST_CLASSES)
    hubs = materialise(large.groupBy(key).agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("__size")), "near-hubs")
    return join_groups(large.select(key, "a"), hubs, key, "__size", large.count()).select("a", "b")


def compare_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that link."""
    nodes = materialise(pairs.select(F.col("a").alias("__k1")).union(pairs.select("b")).distinct(), "near-paired")
    unique = sets.join(bounded_broadcast(nodes), "__k1", "left_semi").dropDuplicates(["__k1"])
    with_a = join_copies(pairs, unique.select(F.col("__k1").alias("a"), F.col("__set").alias("__x")), "a", F.xxhash64("b"), PAIRS)
    both = join_copies(with_a, unique.select(F.col("__k1").alias("b"), F.col("__set").alias("__y")), "b", F.xxhash64("a"), PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column("__x"), batch.column("__y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                common = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))
        release_memory()

    return both.select("a", "b", "__x", "__y").mapInArrow(run, "a bigint, b bigint")


def blocks(members: DataFrame) -> DataFrame:
    """members (root, __k1, __n) with a __block, of bounded size.

    A set's place among its family's is after all smaller ones and, among those of its size, at a hashed fraction of their weight:
    blocks follow from weights added up by family and size, and have about BLOCK_SHINGLES; no family is sorted in one task.
    """
    weight = F.greatest(F.col("__n"), F.lit(BLOCK_SHINGLES // BLOCK_DOCS))
    sizes = members.groupBy("root", "__n").agg(F.sum(weight).alias("__w"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("root").orderBy("__n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__start", F.coalesce(F.sum("__w").over(before), F.lit(0)))
    key = F.xxhash64("root", "__n").alias("__size")
    sizes = materialise(sizes.select(key, F.col("root").alias("__r"), F.col("__n").alias("__s"), "__w", "__start", "__rows"), "near-sizes")
    placed = join_groups(members.withColumn("__size", key), sizes, "__size", "__rows", members.count()).where("root = __r and __n = __s")
    fraction = F.pmod(F.xxhash64("__k1"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    block = F.floor((F.col("__start") + fraction * F.col("__w")) / BLOCK_SHINGLES).cast("int")
    out = materialise(placed.select("root", "__k1", "__n", block.alias("__block")), "near-members")
    discard(sizes)
    return out


def _laid(members: DataFrame, tasks: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows for compare_blocks: the sets of members (root, __k1, __block) for each task (root, __block, __task, __side) of their block."""
    listed = tasks.groupBy("root", "__block").agg(F.collect_list(F.struct("__task", "__side")).alias("__tasks"))
    listed = listed.select(F.xxhash64("root", "__block").alias("__place"), F.col("root").alias("__r"), F.col("__block").alias("__b"), "__tasks")
    wanted = members.withColumn("__place", F.xxhash64("root", "__block")).join(bounded_broadcast(listed), "__place").where("root = __r and __block = __b").select("__k1", "__tasks")
    return sets.join(bounded_broadcast(wanted), "__k1").select(F.explode("__tasks").alias("t"), "__k1", "__set").select("t.*", "__k1", "__set")


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b within families: members have root (their family), __k1, __n."""
    counts = materialise(members.groupBy("root").agg(F.count(F.lit(1)).alias("__size")), "near-families")
    share = F.pmod(F.xxhash64("__k1", F.lit(7)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    hub = (share < F.lit(float(HUBS)) / F.col("__size")) | (F.col("__k1") == F.col("root"))
    members = materialise(join_groups(members, counts, "root", "__size", members.count()).withColumn("__hub", hub).drop("__size"), "near-family-members")
    hubs = members.where("__hub").select("root", "__k1", F.lit(-1).alias("__block"))
    rest = blocks(members.where("NOT __hub").drop("__hub"))

    # Each block of the rest with the hubs; and the hubs with each other.
    own = rest.select("root", "__block").distinct().withColumn("__task", F.xxhash64("root", "__block"))
    among = hubs.select("root", "__block").distinct().withColumn("__task", F.xxhash64("root", F.lit(-1)))
    tasks = own.withColumn("__side", F.lit(0)).unionByName(own.select("root", F.lit(-1).alias("__block"), "__task", F.lit(1).alias("__side"))).unionByName(among.withColumn("__side", F.lit(0)))
    first = materialise(compare_blocks(_laid(rest.select("root", "__k1", "__block").unionByName(hubs), tasks, sets), percent), "near-links")

    # Who is not in the component of the family's root has to be compared with all.
    found = materialise(components(first, "near-family"), "near-found").select(F.col("node").alias("__k1"), F.col("root").alias("__label"))
    mains = found.join(bounded_broadcast(counts.select(F.col("root").alias("__k1"))), "__k1", "left_semi").select(F.col("__k1").alias("root"), F.col("__label").alias("__main"))
    labelled = members.select("root", "__k1", "__n").join(found, "__k1", "left")
    labelled = join_groups(labelled, mains.join(counts, "root"), "root", "__size", members.count(), how="left")
    labelled = materialise(labelled.select("root", "__k1", "__n", F.coalesce(F.col("__label") == F.col("__main"), F.lit(False)).alias("__in")), "near-labelled")
    apart = labelled.where("NOT __in").select("root", "__k1", "__n")
    if apart.isEmpty():
        return first
    with_apart = apart.select("root").distinct()
    outer, inner = blocks(apart), blocks(labelled.where("__in").join(bounded_broadcast(with_apart), "root", "left_semi").select("root", "__k1", "__n"))
    placed = materialise(outer.unionByName(inner.withColumn("__block", -2 - F.col("__block"))), "near-placed")
    ranges = materialise(placed.groupBy("root", "__block").agg(F.min("__n").alias("__least"), F.max("__n").alias("__most")), "near-ranges")
    left, right = (ranges.select("root", *(F.col(c).alias(f"{c}_{s}") for c in ("__block", "__least", "__most"))) for s in "ij")
    fits = f"100 * __most_i >= {percent} * __least_j and 100 * __most_j >= {percent} * __least_i"
    pairs = left.where("__block_i >= 0").join(right, "root").where(f"(__block_j < 0 or __block_i <= __block_j) and {fits}")
    pairs = materialise(pairs.select("root", "__block_i", "__block_j", F.xxhash64("root", "__block_i", "__block_j").alias("__task")), "near-tasks")
    sides = pairs.select("root", F.col("__block_i").alias("__block"), "__task", F.lit(0).alias("__side"))
    sides = sides.unionByName(pairs.where("__block_i != __block_j").select("root", F.col("__block_j").alias("__block"), "__task", F.lit(1).alias("__side")))
    return first.unionByName(compare_blocks(_laid(placed.select("root", "__k1", "__block"), sides, sets), percent))


def near_links(docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links a, b between classes (__k1, __n, __rep, __bands), confirmed on full sets; spanning, not all."""
    bands = classes.select(F.explode("__bands").alias("__band"), F.col("__k1").alias("a"), F.col("__n").alias("n"))
    shared = _groups(bands, "__band", classes.agg(F.sum(F.size("__bands"))).first()[0] or 0, "near-bands")
    sizes = classes.select("__k1", "__n", "__rep")
    wanted = materialise(sizes.join(bounded_broadcast(shared.select(F.col("a").alias("__k1")).distinct()), "__k1", "left_semi"), "near-wanted")
    texts = docs.join(bounded_broadcast(wanted.select("__rep").distinct()), docs["__id"].eqNullSafe(F.col("__rep")), "left_semi")
    sets = materialise(full_sets(texts, width).join(bounded_broadcast(wanted.select("__k1")), "__k1", "left_semi"), "near-sets")

    pairs, families = _pairs(shared, "__band", percent), None
    dense = materialise(shared.where(F.col("__m") > MOST_CLASSES).select(F.col("a").alias("__k1")).distinct(), "near-dense")
    if not dense.isEmpty():
        own = sets.join(bounded_broadcast(dense), "__k1", "left_semi")
        rows = materialise(prefixes(own, shingle_slots(own), percent), "near-prefixes")
        rare = _groups(rows, "__shingle", rows.count(), "near-rare")
        discard(rows)
        pairs = pairs.unionByName(_pairs(rare, "__shingle", percent))
        stars = materialise(_stars(rare, "__shingle"), "near-stars")
        if not stars.isEmpty():
            families = components(stars, "near-families").withColumnRenamed("node", "__k1").join(sizes.select("__k1", "__n"), "__k1")
            families = materialise(families, "near-family")
            # What family members have in common besides is compared with the family.
            within = [bounded_broadcast(families.select(F.col("__k1").alias(x), F.col("root").alias(f"__{x}"))) for x in "ab"]
            pairs = pairs.join(within[0], "a", "left").join(within[1], "b", "left").where("__a IS NULL OR __b IS NULL OR __a != __b").select("a", "b")
    pairs = materialise(pairs.distinct(), "near-pairs")

    # Clusters of pairs that fit into a block are a task each; of larger ones, the pairs.
    weight = F.greatest(F.col("__n"), F.lit(BLOCK_SHINGLES // BLOCK_DOCS))
    clusters = components(pairs, "near-clusters").withColumnRenamed("node", "__k1").join(sizes.select("__k1", "__n"), "__k1")
    clusters = materialise(clusters, "near-clusters")
    heavy = materialise(clusters.groupBy("root").agg(F.sum(weight).alias("__w")).where(F.col("__w") > BLOCK_SHINGLES).select("root"), "near-heavy")
    light = clusters.join(bounded_broadcast(heavy), "root", "left_anti").select("__k1", F.col("root").alias("__task"))
    links = compare_blocks(sets.join(bounded_broadcast(light), "__k1").withColumn("__side", F.lit(0)), percent)
    if not heavy.isEmpty():
        inside = clusters.join(bounded_broadcast(heavy), "root", "left_semi").select(F.col("__k1").alias("a"))
        links = links.unionByName(compare_pairs(materialise(pairs.join(bounded_broadcast(inside), "a", "left_semi"), "near-heavy-pairs"), sets, percent))
    if families is not None:
        links = links.unionByName(family_links(families, sets, percent))
    return links


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, permutations: int = PERMUTATIONS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept. Linked: 100 * intersection >= percent * union of shingle sets.

    A shorter text than width words is one shingle. Null, empty and blank texts have no shingles and are linked with nothing:
    their component is their own id. component_id is the least id in the component, kept whether it is the row's own; null ids
    take part in links, count last, and where all are null the component is null. Repeated rows are in one component, and all
    rows with its least id are kept. An empty table gives no rows. Other columns are not carried.
    """
    narrow = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    marked = materialise(sketch(narrow, width, permutations, rows), "near-sketches")
    classes = marked.where("__n > 0").groupBy("__k1", "__k2", "__n").agg(F.min("__id").alias("__rep"), F.first("__bands").alias("__bands"), F.count(F.lit(1)).alias("__rows"))
    classes = materialise(classes, "near-classes")
    links = materialise(near_links(narrow, classes, width, percent), "near-links")
    found = components(links, "near-components")
    labelled = classes.select("__k1", "__rep", "__rows").join(found.withColumnRenamed("node", "__k1"), "__k1", "left").withColumn("root", F.coalesce("root", "__k1"))
    least = labelled.groupBy("root").agg(F.min("__rep").alias("__component"))
    labels = materialise(labelled.join(least, "root").select("__k1", "__component", "__rows"), "near-labels")
    own = marked.where("__n = 0").select("__id", "__n", F.col("__id").alias("__component"))
    # Rows of a set that many documents have stay where they are.
    full = join_groups(marked.where("__n > 0"), labels, "__k1", "__rows", marked.count()).select("__id", "__n", "__component")
    return own.unionByName(full).select(
        F.col("__id").alias(id_col), F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"), F.col("__id").eqNullSafe(F.col("__component")).alias("kept")
    )
