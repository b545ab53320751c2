"""Quality classifier: vectors and features against plain Python, gradients, temperature, held-out texts, odd rows."""

import re

import numpy as np
import pyarrow as pa
import pytest
from odd_rows import docs, odd  # noqa: F401
from pyspark.sql import functions as F

from tamis.llm import quality_net as q

TEXTS = ["The cat, the dog!! 12", "", None, "x", "ééé ### ÀB c3", "a b\x0bc d", " ".join(f"w{i % 50}" for i in range(3000))]


def plain_tokens(text):
    raw = (text or "").encode()
    return re.findall(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff \t-\r]+", raw)


def buckets(texts):
    """The bucket of each distinct token, by tokenising it alone."""
    words = sorted({w for t in texts for w in plain_tokens(t)})
    return {w: int(q.tokens(pa.array([w.decode("utf-8", "surrogateescape")]))[0][0]) for w in words if w.decode("utf-8", "replace").encode() == w}


def test_tokens():
    bucket, first = q.tokens(pa.array(TEXTS))
    assert np.diff(first).tolist() == [len(plain_tokens(t)) for t in TEXTS]
    alone = buckets(TEXTS)
    for i, t in enumerate(TEXTS):
        assert [alone[w] for w in plain_tokens(t)] == bucket[first[i] : first[i + 1]].tolist()
    assert len(set(alone.values())) == len(alone)
    sliced = q.tokens(pa.array(TEXTS).slice(3, 2))
    assert sliced[0].tolist() == bucket[first[3] : first[5]].tolist()


def plain_vectors(texts):
    index = q.index_vectors().astype(np.int64)
    out = np.zeros(index.shape)
    for t in texts:
        own = q.tokens(pa.array([t], pa.string()))[0]
        for i, b in enumerate(own):
            for j in range(max(0, i - q.WINDOW), min(len(own), i + q.WINDOW + 1)):
                if i != j:
                    out[b] += index[own[j]]
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(size > 0, size, 1)


def test_vectors(spark):
    assert (np.abs(q.index_vectors()).sum(1) == q.NONZERO).all()
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    one, many = q.word_vectors(df.coalesce(1)), q.word_vectors(df.repartition(5))
    assert (one == many).all() and np.allclose(one, plain_vectors(TEXTS), atol=1e-6)


def test_features():
    vectors = plain_vectors(TEXTS).astype(np.float32)
    got = q.pooled(pa.array(TEXTS), vectors)
    for i, t in enumerate(TEXTS):
        own = vectors[q.tokens(pa.array([t], pa.string()))[0]].astype(np.float64)
        wanted = np.concatenate((own.mean(0), own.std(0))) if len(own) else np.zeros(2 * q.DIMENSIONS)
        assert np.allclose(got[i], wanted, atol=2e-4)


def test_gradients():
    draw = np.random.default_rng(1)
    x, y = draw.normal(size=(20, 6)), (draw.random(20) > 0.4).astype(float)
    net = q.Network(x.mean(0), x.std(0), draw.normal(size=(6, 5)), draw.normal(size=5), draw.normal(size=5), np.array(0.3))
    for name, grad in zip(("inner", "inner_bias", "outer", "outer_bias"), q.gradients(net, x, y), strict=True):
        weight = getattr(net, name)
        for at in np.ndindex(weight.shape):
            keep = weight[at]
            values = []
            for step in (1e-5, -1e-5):
                weight[at] = keep + step
                values.append(q.loss(net.logits(x), y))
            weight[at] = keep
            assert grad[at] == pytest.approx((values[0] - values[1]) / 2e-5, abs=1e-6)


def test_temperature():
    draw = np.random.default_rng(2)
    logits = draw.normal(size=20_000)
    label = (draw.random(20_000) < q.sigmoid(logits)).astype(float)
    assert q.temperature(3 * logits, label) == pytest.approx(3, rel=0.1)
    net = q.train(np.stack((logits, draw.normal(size=20_000)), axis=1)[:2000], label[:2000], np.arange(2000) % 5 == 0)
    scores = net.scores(np.array([[-3.0, 0], [0.0, 0], [3.0, 0]]))
    assert scores[0] < 0.15 < 0.35 < scores[1] < 0.65 < 0.85 < scores[2]


@pytest.fixture(scope="module")
def labelled(spark, docs):  # noqa: F811
    """Texts of the test documents, half of them with each word marked, or shouted, or repeated."""
    clean = docs.select("doc_id", "text").where("length(text) > 200")
    marked = F.regexp_replace("text", r"(\w+)\s", r"$1### ")
    shouted = F.concat(F.regexp_replace(F.upper("text"), r"(\w+)\s", r"$1!! "))
    junk = clean.select((F.col("doc_id") + 10_000).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, marked).otherwise(shouted).alias("text"))
    texts = clean.unionByName(junk).cache()
    return texts, texts.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_held_out_texts(labelled):
    texts, labels = labelled
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = q.fit(texts, labels, ~out)
    scored = q.score(texts, model).where(out).toPandas()
    good = scored["doc_id"] < 10_000
    assert len(scored) > 40 and (scored["predicted"] == good).mean() > 0.95
    assert scored["score"].between(0, 1).all() and ((scored["score"] >= q.CUT) == scored["predicted"]).all()
    # The labels of rows that are not learned from make no difference, and neither does the layout.
    other = q.fit(texts.repartition(7), labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality"))), ~out)
    assert (other.vectors == model.vectors).all() and np.allclose(other.network.inner, model.network.inner)
    bounded = q.sample(texts, labels, ~out, texts.sparkSession.sparkContext.broadcast(model.vectors), "doc_id", "text", "quality", 30)
    assert len(bounded[1]) <= 30


def test_odd_rows(spark, odd):  # noqa: F811
    labels = odd.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")).unionByName(spark.createDataFrame([(1, None), (None, 1), (77, 1)], "doc_id bigint, quality int"))
    model = q.fit(odd, labels, F.lit(True))
    rows = q.score(odd, model).collect()
    assert len(rows) == odd.count() and q.score(odd, model).columns == [c for c in odd.columns if c != "score"] + ["score", "predicted"]
    assert all(0 <= r["score"] <= 1 for r in rows) and len({r["score"] for r in rows if not (r["text"] or "").strip()}) == 1
    none = q.fit(odd.where("false"), labels.where("false"), F.lit(True))
    assert none.network is None and {r["score"] for r in q.score(odd, none).collect()} == {0.5}
    assert q.score(odd.where("false"), none).count() == 0
    one_sided = q.fit(odd, labels.where("quality = 1"), F.lit(True))
    assert one_sided.network is None and q.score(odd, one_sided).first()["predicted"] == 1
