"""Merkle manifests against a tree built node by node."""

from hashlib import sha256
from itertools import groupby

import pytest
from odd_rows import docs, odd  # noqa: F401
from pyspark.sql import functions as F

from tamis.llm import merkle_manifest, queries
from tamis.llm.merkle_manifest import Forest, climb, manifest

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def fold(nodes, i):
    """Root of the nodes and the proof of the i-th: (sibling or "", whether it is on the left), level by level."""
    proof = []
    while len(nodes) > 1:
        proof.append((nodes[i ^ 1] if i ^ 1 < len(nodes) else "", i & 1))
        nodes = [h(*nodes[j : j + 2]) for j in range(0, len(nodes), 2)]
        i //= 2
    return nodes[0], proof


def expected(rows, change):
    """(id, leaf) -> the row's other columns, for rows without equal (id, leaf)."""
    rows = sorted(rows, key=lambda r: (r["lang"] is not None, (r["lang"] or "").encode(), r["doc_id"] is not None, r["doc_id"] or 0, leaf([r[f] for f in FIELDS])))
    trees = [list(g) for _, g in groupby(rows, key=lambda r: r["lang"])]
    leaves = [[leaf([r[f] for f in FIELDS]) for r in t] for t in trees]
    roots = [fold(x, 0)[0] for x in leaves]
    out = {}
    for a, tree in enumerate(trees):
        root, above = fold(roots, a)
        for i, r in enumerate(tree):
            path = fold(leaves[a], i)[1] + above
            at = leaf([change(r) if f == "n_chars" else r[f] for f in FIELDS])
            for digest, left in path:
                at = h(digest, at) if left else h(at, digest)
            out.setdefault((r["doc_id"], leaves[a][i]), []).append((roots[a], root, h(*(d for d, _ in path)), at, at == root))
    return out


def bump(r):
    return None if r["n_chars"] is None else r["n_chars"] + (1 if (r["doc_id"] or 0) % 3 == 0 else 0)


def claim():
    return {"n_chars": F.when(F.coalesce("doc_id", F.lit(0)) % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault((r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]))
    return {k: sorted(v) for k, v in out.items()}


def same(df, change=bump, claimed=claim, **options):
    wanted = expected([r.asDict() for r in df.select(*FIELDS).collect()], change)
    assert found(manifest(df, FIELDS, claimed=claimed and claimed(), **options)) == {k: sorted(v) for k, v in wanted.items()}


def test_odd_rows(odd):  # noqa: F811
    same(odd)
    same(odd, lambda r: r["n_chars"], None)
    assert manifest(odd.where("false"), FIELDS).count() == 0
    one = manifest(odd.where("doc_id = 7"), FIELDS).first()
    assert one["proof"] == [] and one["root"] == one["subroot"] == one["leaf"] and one["verified"]


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_small_blocks(docs, monkeypatch, bits):  # noqa: F811
    """Trees of many blocks, so that the forest has most levels; and as many groups as rows."""
    monkeypatch.setattr(merkle_manifest, "LEAST_BLOCK_BITS", bits)
    monkeypatch.setattr(merkle_manifest, "BLOCK_BITS", 30)
    same(docs)
    same(docs.limit(37).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.concat("lang", F.col("doc_id").cast("string")))))


def test_proofs_are_checked(docs):  # noqa: F811
    for r in manifest(docs.limit(9), FIELDS).collect():
        at = r["leaf"]
        for s in r["proof"]:
            at = h(s[1:], at) if s.startswith("<") else h(at, s[1:])
        assert at == r["root"]


@pytest.mark.parametrize("n", [2, 3, 5, 8, 13, 21])
def test_forest_is_a_monoid(n):
    nodes = [h(str(i)) for i in range(n)]
    wanted = climb(nodes, None)

    def part(own):
        out = Forest({"t": n})
        for i in own:
            out.add("t", 0, i, nodes[i])
        return out

    for cut in ([range(n)], [range(0, n, 2), range(1, n, 2)], [[i] for i in reversed(range(n))], [range(n // 2, n), [], range(n // 2)]):
        total = part(cut[0])
        for other in cut[1:]:
            total = total.merge(part(other))
        assert total.roots() == [("t", wanted[-1][0])]
        assert total.closed == {("t", j, i): d for j, level in enumerate(wanted[:-1]) for i, d in enumerate(level)}


def test_query_equals_sql(spark, sf, duck):
    from conftest import same_rows

    same_rows(queries.QUERIES["op13_merkle_manifest"](spark, sf), duck.sql(queries.ORACLES["op13_merkle_manifest"]).df())
