"""Spelling variants: automata against brute force, splits of frequent halves, whole results against plain Python and SQL."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from odd_rows import LOWER, docs, odd  # noqa: F401
from pyspark.sql import functions as F

from tamis.llm import queries
from tamis.llm.spelling_variants import Alteration, Automaton, near_pairs, variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected(rows, least_chars=6, least_count=5, ratio=5, modulus=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if modulus and h % modulus == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_count}
    cut = {}
    for w in words:
        for i in range(len(w) + 1):
            cut.setdefault(w[:i] + "?" + w[i:], set()).add(w)  # one more letter than the word has
            if i < len(w):
                cut.setdefault(w[:i] + "?" + w[i + 1 :], set()).add(w)
    out = {}
    for w, n in words.items():
        forms = {w[:i] + "?" + w[i:] for i in range(len(w) + 1)} | {w[:i] + "?" + w[i + 1 :] for i in range(len(w))}
        others = {o for f in forms for o in cut[f] if o != w and near(w, o)}
        best = min(((-words[o], o) for o in others), default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, None, n, len(others), words[form] if form else None]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row[1] = root
    return {w: tuple(r) for w, r in out.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize(("seed", "letters", "count", "lengths"), [(1, "ab", 200, (1, 8)), (2, "abcé", 300, (3, 7)), (3, "abcdefghij", 400, (6, 6)), (4, "a", 9, (1, 9)), (5, "xyz", 1, (4, 4))])
def test_automaton(seed, letters, count, lengths):
    draw = random.Random(seed)
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(*lengths))).encode("latin-1") for _ in range(count)})
    machine = Automaton(np.array(words))
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in {w[:i] for w in words for i in range(len(w) + 1)}}
    assert len(machine.final) == len(endings)  # minimal
    for i, w in enumerate(words):  # numbered in their order
        state, number = np.array([machine.root]), 0
        for c in w:
            _, e = machine.follow(state, np.array([c]))
            number, state = number + int(machine.skip[e[0]]), machine.target[e]
        assert number == i and machine.final[state[0]]
    asked = words + [b"q" * 5]
    length = np.array([len(w) for w in asked])
    for low, high in ((length * 0, length), (length // 2, length), (length // 3, length // 2)):
        q, k = machine.near(np.array(asked), low, high)
        got = set(zip(q.tolist(), k.tolist(), strict=True))

        def reachable(a, b, lo, hi):
            edits = [a[:i] + b[i : i + 1] + a[i + 1 :] for i in range(lo, hi)] + [a[:i] + a[i + 1 :] for i in range(lo, hi)] + [a[:i] + b[i : i + 1] + a[i:] for i in range(lo, hi + 1) if i < len(b)]
            return a != b and b in edits

        assert got == {(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if reachable(a, b, int(low[i]), int(high[i]))}


@pytest.mark.parametrize("most", [2, 16, 10_000])
def test_pairs_of_frequent_halves(spark, most):
    """Words that all share a half, or nearly all of their letters: keys are split, no pair is lost."""
    draw = random.Random(7)
    words = {"common" + "".join(draw.choice("abcd") for _ in range(draw.randint(1, 6))) for _ in range(250)} | {"".join(draw.choice("ab") for _ in range(draw.randint(1, 6))) + "ending" for _ in range(80)} | {"x" * n for n in range(6, 30)}
    df = spark.createDataFrame([(w, len(w)) for w in words], "word string, n bigint")
    got = [(r["word"], r["near"], r["near_n"]) for r in near_pairs(df, most).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b, len(b)) for a in words for b in words if a != b and near(a, b)}


@pytest.mark.parametrize("options", [{}, {"least_chars": 3, "least_count": 1, "ratio": 2}])
def test_variants(docs, options):  # noqa: F811
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    own = found(variants(docs, alter=Alteration(199), **options))
    assert own == expected(rows, **options) and any(r[0] for r in own.values())


def test_odd_rows(spark, odd):  # noqa: F811
    text = "Colour colour COLOUR colour colour " * 8 + "color " * 6 + "colours " * 30 + "b" * 9000 + " " + ("b" * 8999 + "c ") * 6 + "straße ×××÷÷÷ÿ "
    more = spark.createDataFrame([(100, text * 2, "en", "a", 1, 1, "x", "y"), (101, "ÀÉÎ" * 3 + " nn  ŵords", None, None, None, 1, "x", "y")], odd.schema)
    rows = odd.unionByName(more)
    plain = [(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()]
    for options in ({}, {"least_chars": 1, "least_count": 1}):
        small = {"least_chars": 6, "least_count": 1} if options else {}
        assert found(variants(rows, alter=Alteration(7), **small)) == expected(plain, modulus=7, **small)
    assert found(variants(rows)) == expected(plain, modulus=0)
    assert variants(rows.where("false")).count() == 0 and variants(rows.where("text is null")).count() == 0
    assert variants(rows.withColumn("text", F.lit(None).cast("string"))).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_equals_sql(spark, sf, duck):
    own = found(queries.QUERIES["op12_spelling_variants"](spark, sf))
    sql = duck.sql(queries.ORACLES["op12_spelling_variants"]).fetchall()
    assert own == {r[0]: tuple(r[1:]) for r in sql}
