"""The corpus pipeline: each stage on its own input, and the whole."""

import hashlib
import math
from collections import Counter

from odd_rows import docs, odd, words  # noqa: F401

import corpus_pipeline as p
from tamis.llm.queries import QUERIES, piece_model
from test_native_ops import brute_exact
from test_words_ops import brute_near


def test_stages(spark, sf, docs):
    import sentencepiece

    stages = dict(p.STAGES)
    assert list(stages) == ["language_id", "exact_copies", "near_copies", "mixed", "pieces"]
    now = docs
    for name in list(stages)[:-1]:
        after = p.materialise(stages[name](spark, now, sf), f"test-{name}")
        assert after.columns == docs.columns
        if name != "mixed":
            assert after.select("doc_id", "text").exceptAll(now.select("doc_id", "text")).count() == 0
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in now.select("doc_id").collect()}
        now = after
    assert now.count() > 0.4 * docs.count()
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    wanted = Counter((r.doc_id, tuple(library.encode(r.text))) for r in now.collect())
    got = stages["pieces"](spark, now, sf).collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == wanted
    assert Counter((r.doc_id, r.n_tokens) for r in p.run(spark, sf).collect()) == Counter((r.doc_id, r.n_tokens) for r in got)


def brute_copies(rows):
    """Copies of each document after mixing: a Poisson number, from a hash, with the mean that the root of its source's bytes gives."""
    def hashed(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52

    sizes = Counter()
    for r in rows:
        sizes[r.source] += len((r.text or "").encode()) + 1
    weights = {s: b**0.5 for s, b in sizes.items()}
    out = Counter()
    for r in rows:
        rate = weights[r.source] / sum(weights.values()) * sum(sizes.values()) / sizes[r.source]
        parts = max(1, math.ceil(rate / 16))
        for part in range(parts):
            u, k, p = hashed(f"mix|{r.doc_id}|{part}"), 0, math.exp(-rate / parts)
            c = p
            while u >= c:
                k += 1
                p *= rate / parts / k
                c += p
            out[r.doc_id] += k
    return +out


def test_stages_equal_a_brute_force(spark, sf, docs):
    """Which documents each stage keeps, and how often: from its own input, by plain definitions."""
    stages, ids = dict(p.STAGES), lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    told = p.materialise(stages["language_id"](spark, docs, sf), "test-told")
    found = {r.doc_id: r for r in QUERIES["op2_zstd_langid"](spark, sf).collect()}  # which has a brute force of its own
    assert {r.doc_id: r.lang for r in told.collect()} == {d: r.lang_pred for d, r in found.items() if not r.rejected}
    exact = p.materialise(stages["exact_copies"](spark, told, sf), "test-exact")
    groups, _ = brute_exact(told.collect())
    assert ids(exact) == Counter({keep for _, keep, _, _ in groups})
    near = p.materialise(stages["near_copies"](spark, exact, sf), "test-near")
    assert ids(near) == Counter(d for d, _, _, kept in brute_near(exact.collect(), 5, 80) if kept)
    assert ids(near) != ids(exact) != ids(told)
    assert ids(stages["mixed"](spark, near, sf)) == brute_copies(near.collect())


def test_near_stage_keeps_one_of_each_group(spark, odd, sf):
    kept = p.near_copies(spark, odd, sf)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert sum(r.text is not None and "quick" in r.text for r in rows) == 1
    assert sum(not words(r.text) for r in rows) == 3


def test_stages_on_odd_and_empty_rows(spark, odd, sf):
    for name, stage in p.STAGES:
        assert stage(spark, odd, sf).count() >= 0, name
        assert stage(spark, odd.where("doc_id < 0"), sf).count() == 0, name
