"""A Merkle tree over each group of rows, a tree over the groups' roots, and the proof of every row.

H is the lowercase hex sha256 of its inputs one after another. A row's leaf is H of its fields; leaves of a tree ascend by id, and
while a level has several nodes, every two consecutive ones (the last run may be one) become their H.

1. Leaves are hashed by Spark's own functions and stored: nothing later reads the texts again.
2. Rows are dealt by ranges of (tree, id, leaf), so a row's place in its tree is its place in its range plus the rows before it.
3. Rows are dealt to blocks of 2**k consecutive leaves. A block is a whole subtree: it leaves one node, keyed by (tree, level, index).
4. These nodes are fragments of a sparse forest: a commutative monoid, whose merge takes the union and closes each run of
   siblings once it is complete. The number of a tree's leaves tells how many siblings the last run of a level has. treeReduce
   merges the fragments. Only trees of more than one block are in it, and k grows with the rows, so it has at most
   2**BLOCK_BITS blocks and as many more last ones, whatever the input's size.
5. The trees' roots are leaves of one more tree, in which the same steps are taken.
6. Each block is hashed again, now for the steps of each leaf's proof; those above the block come from the closed forest.

Equal ids are in the order of their leaves, a null id comes first. Rows of a tree that are equal in all fields have equal leaves, and
proofs in no fixed order among them. A null group is a tree of its own, before all others. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, join_groups, materialise

#: At most about so many blocks (as a power of two) are in the forest, and a block has at least so many leaves.
BLOCK_BITS = 16
LEAST_BLOCK_BITS = 9
#: Proofs are passed on for so many leaves at once.
SLICE = 4096
# A step of a proof: a mark for the sibling's side and its digest, or nothing where a node is alone in its run.
LEFT, RIGHT = "<", ">"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """H of the fields, each `-` if null, else its bytes' count, `:` and its value as text."""
    texts = [(c, c.cast("string")) for c in fields]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for c, t in texts)), 256)


def parent(run: Sequence[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def climb(digests: Sequence[str], levels: int | None) -> list[list[str]]:
    """The levels of a tree from its leaves: so many more, or up to the root."""
    out = [list(digests)]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        below = out[-1]
        out.append([parent(below[i : i + 2]) for i in range(0, len(below), 2)])
    return out


def steps(level: Sequence[str]) -> list[str]:
    """The step of each node of a level of which every run is here."""
    return ["" if (i ^ 1) >= len(level) else (LEFT if i & 1 else RIGHT) + level[i ^ 1] for i in range(len(level))]


@dataclass
class Forest:
    """Nodes by (tree, level, index): open ones wait for a sibling, closed ones are under a node that is known. leaves: of each tree."""

    leaves: dict[str, int] = field(default_factory=dict)
    open: dict[tuple[str, int, int], str] = field(default_factory=dict)
    closed: dict[tuple[str, int, int], str] = field(default_factory=dict)

    def width(self, tree: str, level: int) -> int:
        return -(-self.leaves[tree] >> level)

    def add(self, tree: str, level: int, index: int, digest: str) -> None:
        """Put in a node, and its ancestors as far as their runs are complete."""
        while (width := self.width(tree, level)) > 1:
            first = index & ~1
            run = [digest if i == index else self.open.get((tree, level, i)) for i in range(first, min(first + 2, width))]
            if None in run:
                break
            for i, d in enumerate(run, first):
                self.open.pop((tree, level, i), None)
                self.closed[tree, level, i] = d
            level, index, digest = level + 1, first >> 1, parent(run)
        self.open[tree, level, index] = digest

    def merge(self, other: Forest) -> Forest:
        self.leaves |= other.leaves
        self.closed |= other.closed
        for (tree, level, index), digest in other.open.items():
            self.add(tree, level, index, digest)
        return self

    def roots(self) -> list[tuple[str, str]]:
        return [(tree, digest) for (tree, level, _), digest in self.open.items() if self.width(tree, level) == 1]


def _fragment(rows: Iterator) -> Iterator[Forest]:
    out = Forest()
    for tree, leaves, level, index, digest in rows:
        out.leaves[tree] = leaves
        out.add(tree, level, index, digest)
    yield out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Append the partition and each row's place among its tree's rows there; trees lie one after another."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        codes = pc.dictionary_encode(batch.column("tree"))
        ids = codes.indices.to_numpy()
        begins = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        at = np.arange(len(ids)) - np.repeat(begins, np.diff(np.append(begins, len(ids))))
        if codes.dictionary[int(ids[0])].as_py() == last:
            at[: begins[1] if len(begins) > 1 else len(ids)] += seen
        last, seen = codes.dictionary[int(ids[-1])].as_py(), int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(at)], [*batch.schema.names, "part", "pos"])


def _placed(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, int]:
    """rows with `at`, the place in the tree, and `leaves`, the tree's number of them; and the number of all rows."""
    keys = ["tree", *order]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    dealt = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_number, f"{schema}, part int, pos bigint"), "merkle-rows")
    # One row for each range and tree: as many as ranges and trees together, and a tree has no more than there are ranges.
    counts = materialise(dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n")), "merkle-counts")
    before = "sum(n) over (partition by tree order by part rows between unbounded preceding and current row) - n"
    starts = counts.selectExpr("tree", "part", f"{before} as start", "sum(n) over (partition by tree) as leaves")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return dealt.join(bounded_broadcast(starts), ["tree", "part"]).withColumn("at", F.col("start") + F.col("pos")).drop("part", "pos", "start"), total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, pa.Table]]:
    """Tree, its leaves, block and the block's rows, from batches in the order of tree, block and place."""
    held: list[pa.RecordBatch] = []
    key = None

    def whole() -> tuple[str, int, int, pa.Table]:
        table = pa.Table.from_batches(held)
        return key[0], table.column("leaves")[0].as_py(), key[1], table

    for batch in batches:
        start = 0
        for own, run in groupby(zip(batch.column("tree").to_pylist(), batch.column("block").to_pylist(), strict=True)):
            size = sum(1 for _ in run)
            if own != key:
                if held:
                    yield whole()
                held, key = [], own
            held.append(batch.slice(start, size))
            start += size
    if held:
        yield whole()


def _tops(bits: int):
    """The node that a block leaves: at level `bits`, or the root of a tree that has no other block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, leaves, block, table in _blocks(batches):
            alone = leaves <= 1 << bits
            top = climb(table.column("leaf").to_pylist(), None if alone else bits)[-1][0]
            yield pa.RecordBatch.from_pylist([{"tree": tree, "leaves": leaves, "level": bits, "idx": block, "digest": top, "alone": alone}], pa.schema([("tree", pa.string()), ("leaves", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("alone", pa.bool_())]))

    return run


def _packed(forest: Forest, bits: int) -> dict[str, list[bytes]]:
    """The closed nodes of each tree, level by level above `bits`, 32 bytes each."""
    out = {}
    for tree in forest.leaves:
        levels, level = [], bits
        while (width := forest.width(tree, level)) > 1:
            levels.append(b"".join(bytes.fromhex(forest.closed[tree, level, i]) for i in range(width)))
            level += 1
        out[tree] = levels
    return out


def _above(levels: Sequence[bytes], block: int) -> list[str]:
    out = []
    for packed in levels:
        other = block ^ 1
        digest = packed[32 * other : 32 * other + 32].hex()
        out.append((LEFT if block & 1 else RIGHT) + digest if digest else "")
        block >>= 1
    return out


def _proofs(bits: int, packed, keep: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tree, leaves, block, table in _blocks(batches):
            alone = leaves <= 1 << bits
            levels = climb(table.column("leaf").to_pylist(), None if alone else bits)[:-1]
            inner = [np.array(steps(level), object) for level in levels]
            above = [] if alone else _above(packed.value[tree], block)
            for a in range(0, table.num_rows, SLICE):
                part = table.slice(a, SLICE).select(keep).combine_chunks()
                at = np.arange(a, a + part.num_rows)
                grid = np.empty((part.num_rows, len(inner) + len(above)), object)
                for j, own in enumerate(inner):
                    grid[:, j] = own[at >> j]
                for j, step in enumerate(above, len(inner)):
                    grid[:, j] = step
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * grid.shape[1])
                path = pa.ListArray.from_arrays(offsets, pa.array(grid.ravel(), pa.string()))
                yield pa.RecordBatch.from_arrays([*(c.chunk(0) for c in part.columns), path], [*keep, "path"])

    return run


def _trees(rows: DataFrame, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """rows have `tree` and `leaf`, both text. Rows with `path`, the steps from a leaf to its tree's root; and the trees: tree, root, leaves."""
    spark = rows.sparkSession
    keep = rows.columns
    placed, total = _placed(rows, order)
    bits = max(LEAST_BLOCK_BITS, total.bit_length() - BLOCK_BITS)
    blocks = placed.withColumn("block", F.shiftright("at", bits)).repartition("tree", "block").sortWithinPartitions("tree", "block", "at")
    tops = materialise(blocks.select("tree", "block", "at", "leaves", "leaf").mapInArrow(_tops(bits), "tree string, leaves bigint, level int, idx bigint, digest string, alone boolean"), "merkle-tops")
    fragments = tops.where("not alone").select("tree", "leaves", "level", "idx", "digest").rdd.mapPartitions(_fragment)
    forest = fragments.treeReduce(Forest.merge) if fragments.getNumPartitions() else Forest()
    large = spark.createDataFrame([(t, d, forest.leaves[t]) for t, d in forest.roots()], "tree string, root string, leaves bigint")
    roots = tops.where("alone").select("tree", F.col("digest").alias("root"), "leaves").unionByName(large)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    packed = spark.sparkContext.broadcast(_packed(forest, bits))
    return blocks.mapInArrow(_proofs(bits, packed, keep), f"{schema}, path array<string>"), roots


def manifest(docs: DataFrame, fields: Sequence[str], id_col: str = "doc_id", tree_col: str = "lang", claimed: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: the id, leaf, subroot, root, proof (an array of steps), proof_sha256, folded_root and verified.

    fields: the columns that a leaf covers, in order. claimed: columns as somebody else gives them, by field; folded_root is folded from the
    claimed leaf and the true siblings, and verified says whether it is the root. Without it each row is checked as it is.
    """
    leaf = leaf_digest([F.col(f"`{f}`") for f in fields])
    other = leaf_digest([(claimed or {}).get(f, F.col(f"`{f}`")) for f in fields])
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit("")).alias("tree"), leaf.alias("leaf"), (other if claimed else F.lit(None).cast("string")).alias("claimed"))
    rows = materialise(rows.withColumn("claimed", F.nullif("claimed", F.col("leaf"))), "merkle-leaves")
    proven, groups = _trees(rows, ["id", "leaf"])
    groups = materialise(groups, "merkle-subroots")
    top = groups.select(F.lit("").alias("tree"), F.col("tree").alias("own"), F.col("root").alias("leaf"), F.col("leaves").alias("size"))
    tops, roots = _trees(top, ["own"])
    root = roots.first()
    tops = tops.select(F.col("own").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("above"), "size")
    tops = materialise(tops, "merkle-paths")
    out = join_groups(proven, tops, "tree", "size", tops.agg(F.sum("size")).first()[0] or 0)
    path = F.concat("path", "above")
    bare = F.transform(path, lambda s: F.substring(s, 2, 64))
    folded = F.aggregate(path, F.coalesce("claimed", "leaf"), lambda acc, s: F.sha2(F.when(s.startswith(LEFT), F.concat(F.substring(s, 2, 64), acc)).otherwise(F.concat(acc, F.substring(s, 2, 64))), 256))
    out = out.select(F.col("id").alias(id_col), "leaf", "subroot", F.lit(root["root"] if root else None).cast("string").alias("root"), path.alias("proof"), F.sha2(F.array_join(bare, ""), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
