"""The registered queries of this subpackage, opN_<name>(spark, sf_dir), and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compact_windows, exact_dedup, gif_media, gru_lm, html_paths, merkle_manifest, minmax_dedup, mixing, piece_table, quality_net, sharding, spelling_variants, zstd_langid


def piece_model() -> str:
    """The place of the public tokenizer's model, for the queries; the operator takes any."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.text_media(_documents(spark, sf_dir))


def op2_zstd_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = zstd_langid.fit(docs, ~zstd_langid.held_out("doc_id", 4, 2))
    found = zstd_langid.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", zstd_langid.held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op3_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.interleave(_documents(spark, sf_dir), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")


def op4_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_windows.repeated_passages(_documents(spark, sf_dir))


def op5_bloom_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(_documents(spark, sf_dir))


def op6_tag_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = zstd_langid.held_out("doc_id", 7, 2)
    scored = gru_lm.log_likelihood(docs, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax_dedup.near_components(_documents(spark, sf_dir), width=4, percent=80)


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.replicate(_documents(spark, sf_dir), power=0.5, epochs=1.0).select("doc_id", "source", F.round("rate", 6).alias("rate"), "copies", "copy", "shuffle_key")


def op10_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.encode_documents(_documents(spark, sf_dir), piece_model())


def op11_quality_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _documents(spark, sf_dir), zstd_langid.held_out("doc_id", 5, 0)
    model = quality_net.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out)
    return quality_net.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.variants(_documents(spark, sf_dir), alter=spelling_variants.Alteration(199))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    docs = _documents(spark, sf_dir)
    proven = merkle_manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], claimed={"n_chars": F.when(touched, F.col("n_chars") + 1).otherwise(F.col("n_chars"))})
    return proven.drop("proof")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_gif_media": op1_gif_media,
    "op2_zstd_langid": op2_zstd_langid,
    "op3_interleave": op3_interleave,
    "op4_compact_windows": op4_compact_windows,
    "op5_bloom_dedup": op5_bloom_dedup,
    "op6_tag_paths": op6_tag_paths,
    "op7_gru_lm": op7_gru_lm,
    "op8_minmax_dedup": op8_minmax_dedup,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_piece_table": op10_piece_table,
    "op11_quality_net": op11_quality_net,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_merkle_manifest": op13_merkle_manifest,
}

_HASH = "CAST('0x' || substr(md5({}), 1, 13) AS BIGINT)"

#: crc32 of a text, with the table of the 256 bytes from a row crc(t).
_CRC_TABLE = "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _crc(text: str, table: str = "t") -> str:
    raw = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {raw}), lambda c, b: xor(c >> 8, {table}[(xor(c, b) & 255) + 1])), 4294967295)"


def _leaf(n_chars: str) -> str:
    columns = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns) + ")"


ORACLES: dict[str, str] = {
    "op5_bloom_dedup": r"""
        WITH k AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
             r AS (SELECT *, row_number() OVER w AS pos, first_value(doc_id) OVER w AS keep_id,
                          count(*) OVER (PARTITION BY text_sha256) AS group_size
                   FROM k WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id))
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, pos = 1 AS kept, text_sha256 FROM r""",
    "op8_minmax_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM w)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
             links AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * common >= 80 * (x.n + y.n - common)),
             reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
             least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
               d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN least l ON d.doc_id = l.a""",
    "op9_poisson_mix": f"""
        WITH s AS (SELECT source, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS DOUBLE) AS b FROM documents GROUP BY source),
             rates AS (SELECT source, pow(b, 0.5) / sum(pow(b, 0.5)) OVER () * 1.0 * sum(b) OVER () / b AS rate FROM s),
             parts AS (SELECT doc_id, d.source, rate, greatest(1, CAST(ceil(rate / 16.0) AS INT)) AS parts FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
             each AS (SELECT *, unnest(range(parts)) AS part FROM parts),
             drawn AS (SELECT doc_id, source, rate, {_HASH.format("'mix|' || doc_id || '|' || part")} / 4503599627370496.0 AS u, rate / parts AS m FROM each),
             tables AS (SELECT DISTINCT m FROM drawn),
             terms AS (SELECT m, k, exp(k * ln(m) - lgamma(k + 1) - m) AS p FROM tables, (SELECT unnest(range(0, 80)) AS k)),
             cdf AS (SELECT m, k, sum(p) OVER (PARTITION BY m ORDER BY k) AS c FROM terms),
             counts AS (SELECT doc_id, source, rate, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.m = drawn.m AND drawn.u >= cdf.c)) AS INT) AS copies FROM drawn GROUP BY ALL),
             rows AS (SELECT *, unnest(range(copies)) AS copy FROM counts)
        SELECT doc_id, source, round(rate, 6) AS rate, copies, CAST(copy AS INT) AS copy, {_HASH.format("'mix-order|' || doc_id || '|' || copy")} AS shuffle_key FROM rows""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE {_CRC_TABLE},
             runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
             each AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
             hashed AS (SELECT run, c, {_crc("(doc_id || ':' || run)")} AS h FROM each, crc),
             made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
             w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
             cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
             pairs AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
                       UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
             best AS (SELECT word, count(*) AS n_near, min({{'less': -near_n, 'near': encode(near)}}) AS best FROM pairs GROUP BY word),
             forms AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN decode(best.near) END AS form, CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM w LEFT JOIN best USING (word)),
             way(word, root, form) AS (SELECT word, word, form FROM forms UNION ALL SELECT v.word, v.form, f.form FROM way v JOIN forms f ON v.form = f.word)
        SELECT f.word, f.form, v.root, f.n, f.n_near, f.form_n FROM forms f JOIN way v ON f.word = v.word AND v.form IS NULL""",
    "op13_merkle_manifest": f"""
        WITH RECURSIVE {_CRC_TABLE},
             leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("n_chars")} AS leaf, {_leaf("(n_chars + 1)")} AS changed, {_crc("CAST(doc_id AS VARCHAR)")} % 7 = 0 AS touched FROM documents, crc),
             placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM leaves),
             below(tree, level, idx, digest, width) AS (
                 SELECT tree, 0, pos, leaf, count(*) OVER (PARTITION BY tree) FROM placed
                 UNION ALL SELECT tree, level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (width + 1) // 2 FROM below WHERE width > 1 GROUP BY tree, level, idx // 2, width),
             roots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM below WHERE width = 1),
             above(level, idx, digest, width) AS (
                 SELECT 0, pos, subroot, count(*) OVER () FROM roots
                 UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx)), (width + 1) // 2 FROM above WHERE width > 1 GROUP BY level, idx // 2, width),
             low(doc_id, leaf, tree, subroot, level, idx, folded, proof) AS (
                 SELECT doc_id, leaf, tree, subroot, 0, p.pos, CASE WHEN touched THEN changed ELSE leaf END, '' FROM placed p JOIN roots USING (tree)
                 UNION ALL SELECT f.doc_id, f.leaf, f.tree, f.subroot, f.level + 1, f.idx // 2, sha256(CASE WHEN f.idx % 2 = 1 THEN s.digest || f.folded ELSE f.folded || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
                 FROM low f JOIN below o ON o.tree = f.tree AND o.level = f.level AND o.idx = f.idx AND o.width > 1 LEFT JOIN below s ON s.tree = f.tree AND s.level = f.level AND s.idx = xor(f.idx, 1)),
             mid AS (SELECT l.*, r.pos FROM low l JOIN roots r USING (tree) JOIN below b ON b.tree = l.tree AND b.level = l.level AND b.width = 1),
             high(doc_id, leaf, subroot, level, idx, folded, proof) AS (
                 SELECT doc_id, leaf, subroot, 0, pos, folded, proof FROM mid
                 UNION ALL SELECT f.doc_id, f.leaf, f.subroot, f.level + 1, f.idx // 2, sha256(CASE WHEN f.idx % 2 = 1 THEN s.digest || f.folded ELSE f.folded || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
                 FROM high f JOIN above o ON o.level = f.level AND o.idx = f.idx AND o.width > 1 LEFT JOIN above s ON s.level = f.level AND s.idx = xor(f.idx, 1))
        SELECT h.doc_id, h.leaf, h.subroot, a.digest AS root, sha256(h.proof) AS proof_sha256, h.folded AS folded_root, h.folded = a.digest AS verified
        FROM high h JOIN above a ON a.level = h.level AND a.width = 1""",
}
