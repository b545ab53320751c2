"""Language identification, near-dedup, language model, piece table, main text, repeated passages: op2, op8, op7, op10, op6, op4."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from conftest import same_rows
from odd_rows import docs, odd, words  # noqa: F401
from pyspark.sql import functions as F

from tamis.llm import common, compact_windows, gru_lm, gru_model, html_paths, minmax_dedup, piece_table, zstd_langid
from tamis.llm.queries import ORACLES, QUERIES, piece_model


def held_out(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


# op2


def test_language_of_held_out_documents(spark, sf, docs):
    rows = QUERIES["op2_zstd_langid"](spark, sf).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    own = [r for r in rows if r.held_out]
    assert {r.doc_id for r in own} == {d for d in lang if held_out(d, 4, 2)}
    told = [r for r in own if r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in told) >= 0.95 * len(told)
    assert all(0 <= r.score <= 1 for r in rows)


def test_languages_equal_a_brute_force(spark, sf, docs):
    """Dictionaries, sizes, winner, score and margin of every document, by the definition."""
    import zstandard

    rows = docs.collect()
    found = defaultdict(dict)
    counts = Counter()
    for r in rows:
        if r.lang is not None and r.text is not None and not held_out(r.doc_id, 4, 2):
            h = int(hashlib.md5(f"langid|{r.doc_id}".encode()).hexdigest()[:13], 16)
            counts[r.lang] += 1
            best = found[r.lang].get(h % zstd_langid.SAMPLE_DOCS)
            if best is None or h < best[0]:
                found[r.lang][h % zstd_langid.SAMPLE_DOCS] = (h, r.text[: zstd_langid.SAMPLE_CHARS].lower())
    languages = sorted(found, key=lambda x: (-counts[x], x))
    packers = []
    for x in languages:
        raw = "\n".join(found[x][b][1] for b in sorted(found[x])).encode()
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        packers.append(lambda data, d=d: len(zstandard.ZstdCompressor(level=zstd_langid.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data)))
    texts = {r.doc_id: r.text for r in rows}
    for r in QUERIES["op2_zstd_langid"](spark, sf).collect():
        text = texts[r.doc_id]
        if text is None or not any(map(str.isalpha, text)):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        raw = text.lower().encode()
        sizes = [sum(pack(raw[i : i + zstd_langid.BLOCK_BYTES]) for i in range(0, len(raw), zstd_langid.BLOCK_BYTES)) for pack in packers]
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        lead = sizes[order[1]] - sizes[order[0]]
        assert r.lang_pred == languages[order[0]] and r.rejected == (lead == 0 or lead + 1 < zstd_langid.MIN_MARGIN * sizes[order[0]])
        assert math.isclose(r.margin, lead / sizes[order[0]]) and math.isclose(r.score, 1 / sum(2.0 ** -min(s - sizes[order[0]], 1000) for s in sizes))


def test_language_verdict():
    model = zstd_langid.Model(("en", "de"), (b"", b""))
    assert zstd_langid.verdict(model, np.array([100, 100]), 0.005)[0::3] == ("en", False)
    assert zstd_langid.verdict(model, np.array([1000, 999]), 0.005)[0::3] == ("de", True)
    assert zstd_langid.verdict(model, np.array([1000, 900]), 0.005)[0::3] == ("de", False)


def test_language_of_odd_rows(odd, docs):
    model = zstd_langid.fit(docs, ~zstd_langid.held_out("doc_id", 4, 2))
    out = zstd_langid.identify(odd, model)
    assert out.columns == [*(c for c in odd.columns if c != "score"), "lang_pred", "score", "margin", "rejected"]
    rows = out.collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r.lang_pred == "und") == (r.text is None or not any(map(str.isalpha, r.text)))
    empty = zstd_langid.fit(odd.where("doc_id < 0"), zstd_langid.held_out("doc_id", 4, 2))
    assert {r.lang_pred for r in zstd_langid.identify(odd, empty).collect()} == {"und"}
    assert zstd_langid.identify(odd.where("doc_id < 0"), model).count() == 0


# op8


def brute_near(rows, width, percent):
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common_words = Counter()
    for own in holders.values():
        for k, i in enumerate(own):
            for j in own[:k]:
                common_words[i, j] += 1
    for (i, j), n in common_words.items():
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r.doc_id is not None and sets[i]:
            least[find(i)].append(r.doc_id)
    out = Counter()
    for i, r in enumerate(rows):
        component = min(least[find(i)], default=None) if sets[i] else r.doc_id
        out[r.doc_id, len(sets[i]), component, r.doc_id == component] += 1
    return out


def test_near_components_of_odd_rows(odd):
    for width in (4, 5):
        got = Counter(tuple(r) for r in minmax_dedup.near_components(odd, width).collect())
        assert got == brute_near(odd.collect(), width, 80)
    assert minmax_dedup.near_components(odd.where("doc_id < 0")).count() == 0


def test_near_components_in_blocks(spark, monkeypatch):
    """Chains of near copies, many of them, compared in small blocks."""
    monkeypatch.setattr(minmax_dedup, "BLOCK_SHINGLES", 900)
    monkeypatch.setattr(minmax_dedup, "BLOCK_DOCS", 9)
    rng, rows = random.Random(3), []
    for group in range(6):
        text = [f"g{group}w{rng.randrange(500)}" for _ in range(120)]
        for _ in range(30):
            text = list(text)
            text[rng.randrange(120)] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(text)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert Counter(tuple(r) for r in minmax_dedup.near_components(df, 4).collect()) == brute_near(df.collect(), 4, 80)


def candidates(df, width=4):
    """Candidate pairs and classes in families of df."""
    narrow = df.selectExpr("doc_id AS __id", "text AS __text")
    marked = minmax_dedup.sketch(narrow, width, minmax_dedup.PERMUTATIONS, minmax_dedup.ROWS)
    bands = marked.selectExpr("explode(__bands) AS __band", "__k1 AS a", "__n AS n")
    shared = minmax_dedup._groups(bands, "__band", bands.count(), "test-bands")
    pairs = minmax_dedup._pairs(shared, "__band", 80)
    sets = minmax_dedup.full_sets(narrow, width).join(shared.where("__m > 16").selectExpr("a AS __k1").distinct(), "__k1", "left_semi")
    rows = minmax_dedup.prefixes(sets, minmax_dedup.shingle_slots(sets), 80)
    rare = minmax_dedup._groups(rows, "__shingle", rows.count(), "test-rare")
    return pairs.unionByName(minmax_dedup._pairs(rare, "__shingle", 80)).distinct().count(), minmax_dedup._stars(rare, "__shingle").count()


def test_a_chain_costs_its_pairs_not_its_square(spark):
    """A chain of 20,000 documents, each at similarity 0.6 to the next: one cluster of candidates, no link."""
    def text(i):
        return " ".join(f"w{i * 10 + j}" for j in range(43))  # 40 shingles, 30 of which the next one has

    df = spark.createDataFrame([(i, text(i)) for i in range(20_000)], "doc_id bigint, text string").repartition(4)
    pairs, families = candidates(df)
    assert 15_000 < pairs < 60_000 and families == 0
    assert minmax_dedup.near_components(df, 4).where("component_id != doc_id").count() == 0


def test_frequent_words_make_no_pairs(spark):
    """3000 documents share 240 of 300 words, and none links: their rarest shingles are their own."""
    rng = random.Random(5)
    common = " ".join(f"c{i}" for i in range(240))
    df = spark.createDataFrame([(i, f"{common} {' '.join(f'u{rng.randrange(10**9)}' for _ in range(60))}") for i in range(3000)], "doc_id bigint, text string").repartition(4)
    pairs, families = candidates(df)
    assert pairs == 0 and families < 100  # those that have a rare shingle in the slot of a frequent one
    assert minmax_dedup.near_components(df, 4).where("component_id != doc_id").count() == 0


def test_families(spark, monkeypatch):
    """Large families of near copies, some of which link with few others, in small blocks."""
    monkeypatch.setattr(minmax_dedup, "BLOCK_SHINGLES", 3000)
    monkeypatch.setattr(minmax_dedup, "BLOCK_DOCS", 25)
    rng, rows = random.Random(7), []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(150)]
        for i in range(150):
            text = list(base)
            for at in rng.sample(range(150), rng.choice([1, 2, 4, 5])):
                text[at] = f"new{rng.randrange(60 if i % 3 else 10**9)}"
            rows.append((len(rows), " ".join(text[: rng.choice([150, 150, 130])])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert candidates(df)[1] > 100
    assert Counter(tuple(r) for r in minmax_dedup.near_components(df, 4).collect()) == brute_near(df.collect(), 4, 80)


def test_op8_sql(spark, sf, duck):
    same_rows(QUERIES["op8_minmax_dedup"](spark, sf), duck.sql(ORACLES["op8_minmax_dedup"]).df())


def test_signatures_are_minima_and_maxima():
    values = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x1234567890ABCDEF)
    got = minmax_dedup.signatures(values, np.array([0, 20, 49]), 3)
    for i, own in enumerate((values[:20], values[20:])):
        for k, a in enumerate(minmax_dedup.multipliers(3)):
            assert (got[i, 2 * k], got[i, 2 * k + 1]) == ((own * a).min(), (own * a).max())


@pytest.mark.parametrize("limit", [2, 100])
def test_joined_groups(spark, limit):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate("aaaaaabbcd")], "k string, i int")
    groups = rows.groupBy("k").count().withColumnRenamed("count", "n")
    assert sorted(map(tuple, common.join_groups(rows, groups, "k", "n", 10, limit).collect())) == [(k, i, "aaaaaabbcd".count(k)) for i, k in enumerate("aaaaaabbcd")]


# op7


def test_language_model_counts_and_gain(spark, sf, docs):
    rows = QUERIES["op7_gru_lm"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    tokens = {d: [*words(t), None] for d, t in texts.items()}
    counts = Counter(w for d, own in tokens.items() if not held_out(d, 7, 2) for w in own)
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(r.doc_id, 7, 2), len(own), sum(w in counts for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in own), rel_tol=1e-6)
        assert r.score <= 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
    same = defaultdict(list)
    for r in rows:
        same[texts[r.doc_id]].append(r)
    assert any(len(own) > 1 for own in same.values())
    for own in same.values():
        assert len({r.base_score for r in own}) == 1 and all(math.isclose(r.score, own[0].score, rel_tol=1e-4) for r in own)


def test_every_word_of_training_documents_trains(docs, monkeypatch):
    """The network is given all words of all training documents and no other, each once."""
    from pyspark.sql import functions as F

    narrow = docs.select(F.col("doc_id").alias("__id"), F.col("text").alias("__text"), (F.col("doc_id") % 3 != 0).alias("__training"))
    counts = gru_lm.unigrams(narrow.where("__training").select("__text"), 64, 1000)
    coded = gru_lm.code_documents(narrow, counts, 4)
    wanted = Counter(len(words(r.text)) for r in docs.collect() if r.doc_id % 3)
    rows = coded.where("__round >= 0").collect()
    assert Counter(len(r["__places"]) // 2 for r in rows) == wanted and {r["__round"] for r in rows} == {0, 1, 2, 3}
    given = []
    for batch in gru_lm._documents(iter(coded.where("__round >= 0").select("__places").toArrow().to_batches()), 5000):
        assert sum(map(len, batch[1])) <= max(5000, max(map(len, batch[1])))
        given += batch[1]
    assert Counter(len(d) - 1 for d in given) == wanted and all(d[-1] == gru_model.END for d in given)
    place = np.concatenate([d[:-1] for d in given])
    assert Counter(place[place > 1].tolist()) == Counter({i: int(n) for i, n in enumerate(counts.vocabulary_counts) if i > 1})


def test_gradients():
    """What training adds to the parameters is along the likelihood's numerical gradient."""
    rng = np.random.default_rng(3)
    text = [np.append(rng.integers(2, 150, 17), 1).astype(np.int32)]
    m = small_network()
    seen = {}
    real = gru_model._climb
    try:
        gru_model._climb = lambda m, name, grad, rate, rows=slice(None): seen.setdefault(name, (rows, grad.copy()))
        gru_model.train(m, text)
    finally:
        gru_model._climb = real

    def likelihood():
        return gru_model.score(m, text, n_lanes=1)[0] / 18

    for name, (rows, grad) in seen.items():
        values = getattr(m, name)
        full = np.zeros_like(values)
        full[rows] = grad
        for at in zip(*(x[:6] for x in np.nonzero(np.abs(full) > 0.3 * np.abs(full).max())), strict=True):
            old = values[at]
            values[at] = old + 0.05
            up = likelihood()
            values[at] = old - 0.05
            down = likelihood()
            values[at] = old
            assert math.isclose((up - down) / 0.1, full[at], rel_tol=0.08, abs_tol=2e-4), (name, at)


def small_network(seed=1):
    return gru_model.create(np.arange(150, 0, -1), 8, seed)


def test_probabilities_sum_to_one():
    m = small_network()
    flat = np.random.default_rng(0).standard_normal((1, 8)).astype(np.float32)
    p = [math.exp(gru_model._softmax_terms(m, flat, np.array([w]), False)[0][0]) for w in range(150)]
    assert abs(sum(p) - 1) < 1e-4


def test_state_goes_on_across_windows():
    m, rng = small_network(), np.random.default_rng(2)
    texts = [np.append(rng.integers(2, 150, n), 1).astype(np.int32) for n in (0, 1, 50, 333, 7)]
    a = gru_model.score(m, texts, n_lanes=2, window=5)
    b = np.array([gru_model.score(m, [t], n_lanes=1, window=1000)[0] for t in texts])
    assert np.allclose(a, b, rtol=1e-4)


def test_training_learns_an_order():
    rng = np.random.default_rng(4)
    texts = [np.append((np.arange(30) + rng.integers(0, 100)) % 100 + 2, 1).astype(np.int32) for _ in range(200)]
    m = small_network()
    before = gru_model.score(m, texts).sum()
    assert gru_model.score(gru_model.train(m, texts, passes=60), texts).sum() > 0.8 * before


def test_language_model_of_odd_rows(odd):
    from pyspark.sql import functions as F

    rows = gru_lm.log_likelihood(odd, F.col("doc_id") != 9, hidden=8, rounds=2).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in odd.collect())
    assert all(math.isfinite(r.score) and r.n_tokens >= 1 for r in rows)
    none = gru_lm.log_likelihood(odd, F.lit(False), hidden=8, rounds=2).collect()
    assert {(r.train_tokens, r.n_known) for r in none} == {(0, 0)}
    assert gru_lm.log_likelihood(odd.where("doc_id < 0"), F.lit(True), hidden=8, rounds=2).count() == 0


# op10


def test_pieces_equal_the_library(odd, docs):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for df in (odd, docs):
        wanted = Counter()
        for r in df.collect():
            ids = library.encode(r.text or "")
            wanted[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
        for table_chunks in (50, piece_table.TABLE_CHUNKS):
            assert Counter(tuple(r) for r in piece_table.encode_documents(df, piece_model(), table_chunks=table_chunks).collect()) == wanted
    assert piece_table.encode_documents(odd.where("doc_id < 0"), piece_model()).count() == 0


def test_pieces_of_random_texts():
    table, rng = piece_table.PieceTable(piece_model()), random.Random(5)
    assert table.separable
    alphabet = [" ", "  ", "\t", "\n", "▁", "a", "Word", "é", " ", "　", "ﬁ", "漢字", "😀", "<s>", "</s>", "<unk>", "\x00", "'s", "1234"]
    for _ in range(500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert table.encode([text])[0] == table.library.encode(text)


# op6

PARAGRAPHS = [f"Paragraph {i} tells, at some length, of the river &amp; its boats; of the town, its people, and their work." for i in range(4)]
PAGE = (
    "<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li>News</ul></nav><div class='cookie-banner'>We use cookies, really.</div>"
    f"<article><h1>Title</h1><p>{PARAGRAPHS[0]}<p>{PARAGRAPHS[1]}</p><p>Short.</p><div class=\"ad\">Buy, buy, buy!</div><p>{PARAGRAPHS[2]}\n <b>bold</b></p><p>{PARAGRAPHS[3]}</p><script>var x = '<p>no</p>';</script></article>"
    "<section id=comments><p>A comment, by a reader, that is rather long, and has much punctuation, too.</p></section><aside>Related, more</aside><footer>Imprint.</footer></body></html>"
)


def test_main_text():
    plain = [p.replace("&amp;", "&") for p in PARAGRAPHS]
    assert html_paths.main_text(PAGE) == "\n".join(["Title", plain[0], plain[1], "Short.", plain[2] + " bold", plain[3]])
    for source in (None, "", "   ", "<div><nav>only a menu</nav></div>", "<!-- x", "<script>x"):
        assert html_paths.main_text(source) == ""
    assert html_paths.main_text("<p") == "<p"  # a tag that never ends is text
    assert html_paths.main_text("<p>" * 3000 + "deep words, here.") == "deep words, here."


class ArticleText(HTMLParser):
    """The blocks of a page's article, by the standard library's parser: for pages whose main text is just that."""

    BLOCKS = {"article", "p", "h1", "h2", "h3", "div", "section", "ul", "li", "pre", "blockquote"}

    def __init__(self):
        super().__init__()
        self.inside, self.skip, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skip += tag in ("script", "style")
        self.blocks += [""] if tag in self.BLOCKS else []
        self.blocks[-1] += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skip -= tag in ("script", "style")
        self.blocks += [""] if tag in self.BLOCKS else []

    def handle_data(self, data):
        if self.inside and not self.skip:
            self.blocks[-1] += data

    def text(self, source):
        self.feed(source)
        self.close()
        return "\n".join(x for b in self.blocks if (x := re.sub(r"[\x20\x09-\x0D]+", " ", b).strip(" ")))


SENTENCES = [f"Paragraph {i} tells, at some length, of the river and its boats; of the town, its people, and their work." for i in range(9)]
BODY = "".join(f"<p>{x}</p>" for x in SENTENCES)
LINKS = '<div class="k1"><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></div>'
COMMENT = '<div class="k4"><b>Ann</b><p>I liked this very much, as a reader, and say so here.</p></div>'
REPORT = "The report, as told to all holders, is good."


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        (f"<nav>Menu</nav><article><section>{BODY}</section><section><h2>More</h2><p>Last words, here.</p></section></article>", [*SENTENCES, "More", "Last words, here."]),
        (f'<div class="layout has-sidebar"><div class="post no-comments">{BODY}</div></div>', SENTENCES),
        (f'<article>{BODY}<p class="share-holder-report">{REPORT}</p></article>', [*SENTENCES, REPORT]),
        (f'<article>{BODY}<div class="share-holder-report"><p>{REPORT}</p></div>{BODY}</article>', [*SENTENCES, REPORT, *SENTENCES]),
        (f"<form action=/x>{LINKS}<div class=a>{BODY}</div></form>", SENTENCES),
        (f"<div class=a>{BODY}</div><form action=/x><p>Name, please: <input> and, if you like, your address.</p></form>", SENTENCES),
        (f'{LINKS}<div class="k2"><h1>Title of it</h1>{BODY}<div class="k7">Buy now!</div>{BODY}</div><div class="k3">{COMMENT}</div><div class="k9">Imprint, 2020.</div>', ["Title of it", *SENTENCES, *SENTENCES]),
        (f'{LINKS}<div class="k2"><h1>Title of it</h1>{BODY}{COMMENT}{COMMENT}</div>', ["Title of it", *SENTENCES]),
        (f"{LINKS}<div class=post><div class=s1>{BODY}</div><div class=s2><h2>End</h2><p>That, then, is all.</p></div></div><div class=cm><p>A reader says that, well, it is so.</p></div>", [*SENTENCES, "End", "That, then, is all."]),
        (f"<article>{BODY}<article><p>A comment, as the standard has them, on the article around it.</p></article></article>", SENTENCES),
        (f"<main><div class=ad>Buy, buy, and buy more of it, dear readers.</div><p>{SENTENCES[0]}</p></main><div class=ad>Buy, now, all of this, and that, and more than that, until nothing at all is left, and then, again, buy.</div>", [SENTENCES[0]]),
        (f"<article><h1>Title</h1>{BODY}<ul><li>First item</li><li>Second item</li></ul><table><tr><td>1<td>2</table><ul><li><a href=/1>Read on</a></li><li><a href=/2>And on</a></li></ul></article>", ["Title", *SENTENCES, "First item", "Second item", "1", "2"]),
    ],
    ids=["sections", "wrapper", "class word", "class word within", "page in form", "form", "neutral names", "neutral comments", "parts", "nested article", "small article", "lists"],
)
def test_main_text_of_pages(page, wanted):
    assert html_paths.main_text(f"<html><head><title>T</title></head><body>{page}</body></html>").split("\n") == wanted


@pytest.mark.parametrize(
    "page",
    ["<a " * 350_000, '<a "' * 250_000, "<div>" * 100_000 + "x, y.", "<div class=x>" * 100_000 + "x, y." + "</div>" * 100_000, "<b>" * 100_000 + "</i>" * 100_000 + "x", "<p><table><tr><td>" + "<div>" * 100_000 + "x, y.", '<p "' * 200_000 + ">", "<" * 1_000_000, "&" * 1_000_000, "<!--" * 250_000, "<script>" * 100_000, "<p " + "a " * 500_000 + ">x."],
    ids=["open tags", "quotes", "deep", "deep, closed", "stray ends", "deep in a cell", "quotes, closed", "less-than", "ampersands", "comments", "scripts", "attributes"],
)
def test_hostile_pages_take_time_in_proportion(page):
    def seconds(source):
        began = time.process_time()
        html_paths.main_text(source)
        return time.process_time() - began

    assert seconds(page) < 8 * min(seconds(page[: len(page) // 4]) for _ in range(2)) + 1


def test_op6_query(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op6_tag_paths"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == ArticleText().text(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url
        assert "\n\n" not in r.text and "  " not in r.text
    assert sum(r.n_chars > 0 for r in rows) >= 0.95 * len(rows)
    odd_pages = spark.createDataFrame([(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "", "t")], "page_id bigint, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_paths.extract(odd_pages).collect()] == [("", 0)] * 3
    assert html_paths.extract(odd_pages.where("page_id = 9")).count() == 0


# op4


def test_compact_windows_equal_naive_ones():
    rng = np.random.default_rng(6)
    for least in (1, 3, 8):
        lengths = [0, 1, 7, 40, 25]
        first = np.concatenate(([0], np.cumsum(lengths)))
        values = rng.permutation(1 << 12)[: first[-1]].astype(np.uint64) << np.uint64(40)
        got = set(zip(*(x.tolist() for x in compact_windows.compact_windows(values, first, least)), strict=True))
        wanted = set()
        for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            for c in range(lo, hi):
                left, right = c, c
                while left > lo and values[left - 1] > values[c]:
                    left -= 1
                while right < hi - 1 and values[right + 1] > values[c]:
                    right += 1
                if right - left + 1 >= least:
                    wanted.add((left, c, right))
        assert got == wanted


def test_planted_passages(spark):
    rng = random.Random(8)

    def fresh(n):
        return [f"v{rng.randrange(10**9)}" for _ in range(n)]

    passage, near = fresh(80), fresh(200)
    changed = [w if i % 60 else f"c{i}" for i, w in enumerate(near)]
    rows = [[*fresh(100), *passage, *fresh(30)], [*passage, *fresh(70)], [*fresh(40), *near], [*fresh(20), *changed, *fresh(9)], fresh(300), fresh(40), fresh(40), *[fresh(90)] * 2, [*fresh(500), *passage]]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id bigint, text string")
    found = {r.doc_id: r for r in compact_windows.repeated_passages(df).collect()}
    assert set(found) == {0, 1, 2, 3, 7, 8, 9}
    assert (found[0].start_word, found[0].end_word) == (100, 180) and (found[1].start_word, found[1].end_word) == (0, 80) and (found[9].start_word, found[9].end_word) == (500, 580)
    assert found[2].n_words > 180 and found[2].shared_with == 3 and (found[7].n_words, found[7].shared_with) == (90, 8)


def test_passages_of_odd_rows(odd):
    rows = compact_windows.repeated_passages(odd.unionByName(odd.where("doc_id = 7").selectExpr("70L AS doc_id", *(f"`{c}`" for c in odd.columns[1:])))).collect()
    assert sorted(r.doc_id for r in rows) == [7, 70] and {r.n_words for r in rows} == {120_000}
    assert compact_windows.repeated_passages(odd.where("doc_id < 0")).count() == 0


def test_op4_finds_all_long_repeats(spark, sf, docs):
    """Every run of 60 words that is in two documents lies in a passage found, but for a few that hashing misses."""
    spans = defaultdict(list)
    for r in QUERIES["op4_compact_windows"](spark, sf).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    holders = defaultdict(set)
    for r in docs.collect():
        w = words(r.text)
        for i in range(len(w) - 59):
            holders[hash(tuple(w[i : i + 60]))].add((r.doc_id, i))
    repeated = [x for own in holders.values() if len({d for d, _ in own}) > 1 for x in own]
    missed = [(d, i) for d, i in repeated if not any(a <= i + 5 and i + 55 <= b for a, b in spans[d])]
    assert len(repeated) > 0 and len(missed) <= 0.02 * len(repeated)


def test_passages_of_frequent_lines(spark):
    """Pairs of documents share 60 words made up of lines that hundreds of others have too."""
    rng = random.Random(11)
    lines = [[f"line{i}w{j}" for j in range(12)] for i in range(20)]

    def lot(n):
        return [w for _ in range(n) for w in rng.choice(lines)]

    rows = []
    for pair in range(60):
        passage = lot(5)
        for _ in range(2):
            rows.append([f"u{rng.randrange(10**9)}" for _ in range(20)] + passage + [f"u{rng.randrange(10**9)}" for _ in range(20)])
    for _ in range(500):
        rows.append([w for _ in range(4) for w in [*lot(2), *(f"u{rng.randrange(10**9)}" for _ in range(5))]])
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id bigint, text string").repartition(4)
    spans = defaultdict(list)
    for r in compact_windows.repeated_passages(df).collect():
        spans[r.doc_id].append((r.start_word, r.end_word))
    assert [i for i in range(120) if not any(a <= 20 and 80 <= b for a, b in spans[i])] == []


def test_passages_apart_and_again():
    """Passages side by side in one text are found apart, moved and repeated in the other."""
    rng = np.random.default_rng(12)

    def fresh(n):
        return rng.integers(0, 1 << 60, n).astype(np.uint64)

    for n, gap in ((60, 19), (100, 40), (200, 40)):
        p, q = fresh(n), fresh(60)
        a, b = np.concatenate((fresh(9), p, q)), np.concatenate((p, fresh(gap), q, fresh(70), p))
        got = compact_windows.common_passages(a, b, 46, 80)
        wanted = {(9, 9 + n, 0, n), (9 + n, 69 + n, n + gap, n + gap + 60), (9, 9 + n, n + gap + 130, 2 * n + gap + 130)}
        assert set(got) == wanted
        back = {(x, y, u, v) for u, v, x, y in compact_windows.common_passages(b, a, 46, 80)}
        assert back == wanted
    p = fresh(60)
    again = [np.concatenate([x for _ in range(300) for x in (p, fresh(30))]) for _ in range(2)]
    got = compact_windows.common_passages(*again, 46, 80)
    assert {g[:2] for g in got} == {g[2:] for g in got} == {(90 * i, 90 * i + 60) for i in range(300)}


def test_main_text_of_sections():
    """Nothing of an article is dropped, wherever most of its text lies."""
    long, short = " ".join(PARAGRAPHS * 3).replace("&amp;", "and"), PARAGRAPHS[0].replace("&amp;", "and")
    for tag in ("section", "div", "blockquote", "pre"):
        page = f"<body><nav>Menu</nav><article><h1>Title</h1><{tag}>{long}</{tag}><{tag}>{short}</{tag}></article><footer>Imprint.</footer></body>"
        assert html_paths.main_text(page) == f"Title\n{long}\n{short}"
    assert html_paths.main_text(f"<body><div><h2>Title</h2><blockquote>{long}</blockquote><p>End.</p></div></body>") == f"Title\n{long}\nEnd."
    assert html_paths.main_text(f"<body><div><div>{long}</div></div><div><div>{short}</div></div></body>") == f"{long}\n{short}"


def test_language_ties_of_short_texts_are_rejected(spark):
    text = "The quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(1, text), (2, "x")], "doc_id bigint, text string")
    same = zstd_langid.Model(("en", "de"), (b"other words", b"other words"))
    assert all(r.rejected and r.margin == 0 for r in zstd_langid.identify(df, same).collect())
    told = zstd_langid.Model(("en", "de"), (text.lower().encode(), b"other words"))
    assert [(r.lang_pred, r.rejected) for r in zstd_langid.identify(df.where("doc_id = 1"), told).collect()] == [("en", False)]
    assert [r.rejected for r in zstd_langid.identify(df, zstd_langid.Model(("en",), (b"other words",))).collect()] == [False, False]


@pytest.mark.parametrize("changed", [False, True])
def test_passages_behind_words_that_all_have(spark, changed):
    """150 pairs of documents share 60 (with a changed word, 75) words each, of which 45 are common to all: nearly every key is hot."""
    rng = random.Random(13)

    def fresh(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    common, rows = [f"common{i}" for i in range(45)], []
    for _ in range(150):
        passage = [*common, *fresh(30 if changed else 15)]
        for copy in range(2):
            own = list(passage)
            if changed and copy:
                own[20] = fresh(1)[0]
            rows.append([*fresh(30), *own, *fresh(30)])
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id bigint, text string").repartition(4)
    found = defaultdict(list)
    for r in compact_windows.repeated_passages(df).collect():
        found[r.doc_id].append(r)
    whole = [i for i in range(300) if any(abs(r.start_word - 30) <= 5 and r.end_word >= len(rows[i]) - 35 and r.shared_with // 2 == i // 2 for r in found[i])]
    assert len(whole) >= 0.98 * 300, len(whole)


def test_passages_longer_than_what_all_have(spark):
    """60 pairs of documents share 55 words, so a hub shares them too; what each pair shares beside them, with a word changed, comes out as well."""
    rng = random.Random(17)

    def fresh(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    common, rows = fresh(55), []
    for _ in range(60):
        passage = [*common, *fresh(8)]
        rows += [[*fresh(20), *own, *fresh(20)] for own in (passage, [*passage[:30], *fresh(1), *passage[31:]])]
    df = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id bigint, text string").repartition(4)
    found = {r.doc_id: (r.start_word, r.end_word) for r in compact_windows.repeated_passages(df).collect()}
    assert found == dict.fromkeys(range(120), (20, 83)), Counter(found.values())


def test_pairs_are_joined_with_texts_once(spark, monkeypatch):
    """How many copies of a text a node's pairs need is counted on the stored pairs, not on pairs that are joined with texts for that."""
    plans, stored = [], common.materialise

    def kept(df, name, *by):
        if name == "parts":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df, name, *by)

    monkeypatch.setattr(common, "materialise", kept)
    passage = " ".join(f"p{i}" for i in range(80))
    df = spark.createDataFrame([(i, f"{passage} own{i}") for i in range(300)], "doc_id bigint, text string")
    assert {(r.start_word, r.end_word) for r in compact_windows.repeated_passages(df).collect()} == {(0, 80)}
    assert len(plans) >= 2 and not any("Join" in x for x in plans)


def test_partners_of_open_stretches():
    """Of 200 sets of shingles those come out that have 8 of 9 of what holds an open stretch, and only those."""
    rng = np.random.default_rng(18)
    own = rng.choice(1 << 16, 120, replace=False).astype("<u2")
    others, wanted = [], []
    for n in range(200):
        lo, long, changed = int(rng.integers(0, 60)), int(rng.integers(40, 60)), int(rng.integers(0, 8))
        part = own[lo : lo + long].copy()
        gaps = rng.choice(np.arange(1, long - 1), changed, replace=False)
        others.append(np.delete(part, gaps))
        marks = np.isin(own, others[-1])
        spans = [(i, j) for i in np.flatnonzero(marks) for j in np.flatnonzero(marks) if j - i >= 45 and 9 * marks[i : j + 1].sum() >= 8 * (j - i + 1)]
        if any(i <= 30 and 76 <= j + 1 for i, j in spans):
            wanted.append(n)
    got = list(compact_windows.partners([own, own], [np.array([30]), np.zeros(0, np.int64)], others, 46))
    assert got[0].tolist() == wanted and len(wanted) > 5 and not len(got[1])


def test_workers_give_memory_back():
    """What a batch took is not kept by the process once its last piece is done: free blocks between small live ones too."""
    from pathlib import Path

    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    blocks = [np.ones(8000) for _ in range(4000)]
    kept = blocks[::200]
    before = resident()
    del blocks
    list(common.text_chunks(common.pa.RecordBatch.from_pydict({"text": ["a"]}), "text"))
    assert len(kept) == 20 and resident() < before - 150e6


_FULL = "A full paragraph of the article, with several words, some commas, and a point at its end. It goes on for a while, so that it is long enough"
_NINE = "".join(f"<p>{_FULL} {i}.</p>" for i in range(9))


@pytest.mark.parametrize("element", ["article", "main"])
@pytest.mark.parametrize(
    ("last", "wanted"),
    [
        ("<div class=x><p>Last words here.</p></div>", ["Last words here."]), ("<div><ul><li>One step</li><li>Two steps</li></ul></div>", ["One step", "Two steps"]),
        ("<div class=w><table><tr><td>Cell one</td><td>Cell two</td></tr></table></div>", ["Cell one", "Cell two"]), ("<div><blockquote>Quoted words.</blockquote></div>", ["Quoted words."]),
        ("<div><figure><figcaption>Words below.</figcaption></figure></div>", ["Words below."]), ("<h2>Sources</h2><ul><li><a href=x>One</a></li><li><a href=y>Two</a></li></ul>", ["Sources", "One", "Two"]),
        ("<ul><li><a href=x>One</a></li><li>Two, plain</li></ul>", ["One", "Two, plain"]), (f"<p class=social>{_FULL}.</p>", [f"{_FULL}."]), (f"<div class=notice><p>{_FULL}.</p></div>", [f"{_FULL}."]), (f"<p class=share>{_FULL}.</p>", [f"{_FULL}."]),
        ("<div class=newsletter><p>Sign up, now.</p></div>", []), (f"<div class=comments><p>{_FULL}.</p></div>", []), (f"<div class=ad>{_FULL}.</div>", []), (f"<div><div class=k><p>{_FULL}</p></div><div class=k><p>Me too.</p></div></div>".replace("<p>", "<span>").replace("</p>", "</span>"), []),
    ],
)
def test_closing_parts_of_an_article(element, last, wanted):
    page = f"<html><body><nav>Home</nav><{element}>{_NINE}{last}</{element}><footer>foot</footer></body></html>"
    assert html_paths.main_text(page).split("\n")[9:] == wanted


def test_ids_tell_paths_apart():
    lines = "<br><br>".join(f"{_FULL} {i}." for i in range(6))
    page = f"<html><body><div id=nav>Home News</div><div id=c>{lines}</div><div id=foot>Copyright 2020</div></body></html>"
    found = html_paths.main_text(page)
    assert found.startswith(_FULL) and "Home" not in found and "Copyright" not in found
    assert html_paths.main_text("".join(f'<p id="p-{i}">{_FULL} {i}.</p>' for i in range(4))).count("\n") == 3


def _thue_morse(bits):
    """A word of a and b, and the one with both exchanged: a polynomial hash modulo 2**64 can't tell them apart."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_long_words_that_sums_cannot_tell_apart(spark):
    one, other = _thue_morse(10)
    from tamis.llm.wordscan import scan

    texts = [one, other, one[:-1], "a", "b", "ab", "a" * 8, "a" * 9, "a" * 16, "\x00", "\x00\x00", "é" * 300]
    hashes = scan(pa.array(texts + texts)).hashes
    assert len(set(hashes.tolist())) == len(texts) and (hashes[: len(texts)] == hashes[len(texts) :]).all()
    df = spark.createDataFrame([(1, f"{one} x y z w"), (2, f"{other} x y z w"), (3, f"{one} x y z w"), (4, one), (5, other)], "doc_id bigint, text string")
    found = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minmax_dedup.near_components(df, width=4).collect()}
    assert found == {1: (1, True), 2: (2, True), 3: (1, False), 4: (4, True), 5: (5, True)}
    counted = gru_lm.log_likelihood(df, F.lit(True)).orderBy("doc_id").collect()
    assert counted[0]["train_tokens"] == 3 * 5 + 2 + 5 and counted[3]["base_score"] != counted[4]["base_score"]


def test_copies_are_looked_at_once(spark, monkeypatch):
    """Rows of windows and of stretches are made for one of equal texts; a bitmap that is full only lets more of them on."""
    stored, sizes = compact_windows.materialise, {}

    def kept(df, name, *by):
        out = stored(df, name, *by)
        sizes.setdefault(name, out.count())
        return out

    monkeypatch.setattr(compact_windows, "materialise", kept)
    passage = " ".join(f"p{i}" for i in range(80))
    texts = [f"{passage} own{i} " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(30)]
    alone = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    whole = {r.doc_id: (r.start_word, r.end_word) for r in compact_windows.repeated_passages(alone).collect()}
    wanted, sizes = sizes, {}
    monkeypatch.setattr(compact_windows, "HOT_BITS", compact_windows.BITMAP_BITS)
    both = alone.union(spark.createDataFrame([(100 + i, texts[7]) for i in range(40)], alone.schema))
    found = {r.doc_id: (r.start_word, r.end_word) for r in compact_windows.repeated_passages(both).collect()}
    assert wanted["repeats-frequent"] == sizes["repeats-frequent"] and wanted["repeats-stretches"] == sizes["repeats-stretches"]
    assert whole == dict.fromkeys(range(30), (0, 80))
    assert found == whole | dict.fromkeys([7, *range(100, 140)], (0, len(texts[7].split())))


def test_pairs_without_a_passage_are_told_soon():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 32, 300, np.uint32)
    b = np.concatenate((a[100:140], rng.integers(0, 1 << 32, 60, np.uint32), a[200:240]))
    c = np.concatenate((rng.integers(0, 1 << 32, 60, np.uint32), a[100:160]))
    assert not compact_windows.may_have_passages(a, b, 46) and compact_windows.common_passages(a, b, 46, 80) == []
    assert compact_windows.may_have_passages(a, c, 46) and compact_windows.common_passages(a, c, 46, 80) == [(100, 160, 60, 120)]
    assert not compact_windows.may_have_passages(a, a[:20], 46)
