"""Queries over the driver's tables for the operators of this subpackage, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evigraph.llm import archives, bpe, collocations, decontamination, embedding_dedup, kneser_ney, language_id, ngram_join, resampling, secrets, sharding, token_files, toxicity

SHARDS = 16
#: The id that ends each document in token files.
END_ID = 2


def op1_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return decontamination.find_leaks(docs, "doc_id", "text", items, "item_id", "text")


def op2_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", width=3, percent=90)


def op3_pstable_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


def op4_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = sharding.assign_shards(docs, "doc_id", [1.0] * SHARDS, [1.0], payload="text")
    return out.select(
        "doc_id",
        F.col("payload_size").alias("size"),
        F.col("payload_crc32").alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        "grown_shard",
    )


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.encode_digests(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def _remainder(n: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op6_bigru_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language_id.fit(docs.filter(_remainder(4) != 2), "doc_id", "text", "lang")
    return language_id.identify(docs, "doc_id", "text", net).select("doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, "doc_id", "text", labels, "doc_id", "toxic", _remainder(3) != 1)
    out = toxicity.score_texts(docs, "doc_id", "text", model)
    return out.select("doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence", "words")


def op8_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(_remainder(5) == 1, F.lit(False))
    model = kneser_ney.fit(docs.filter(~held_out), "text")
    out = kneser_ney.score(docs, "doc_id", "text", model)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


def op9_legacy_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archives.archive_pages(pages, "page_id", "url", "html").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("repository", F.concat_ws("/", "source", "lang"))
    return secrets.digest_columns(secrets.scan_secrets(docs, "doc_id", "text", "repository", "source"), "doc_id")


def op11_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.find_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"), "text", "lang")


def op12_crc_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampling.resample(docs, "doc_id", "text", target, "text")


def op13_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_files.store_tokens(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), END_ID)


QUERIES = {
    "op1_pigeonhole_decontamination": op1_pigeonhole_decontamination,
    "op2_signature_tree_join": op2_signature_tree_join,
    "op3_pstable_embedding_dedup": op3_pstable_embedding_dedup,
    "op4_rendezvous_sharding": op4_rendezvous_sharding,
    "op5_prefix_bpe": op5_prefix_bpe,
    "op6_bigru_language_id": op6_bigru_language_id,
    "op7_noisy_channel_toxicity": op7_noisy_channel_toxicity,
    "op8_kneser_ney_scoring": op8_kneser_ney_scoring,
    "op9_legacy_archives": op9_legacy_archives,
    "op10_secret_ownership": op10_secret_ownership,
    "op11_trie_collocations": op11_trie_collocations,
    "op12_crc_importance_resampling": op12_crc_importance_resampling,
    "op13_rans_token_files": op13_rans_token_files,
}

_KIND_SQL = " UNION ALL ".join(
    f"SELECT doc_id, o, r, {i} AS ord, '{kind}' AS kind, {least} AS least, regexp_extract_all(t, '{p}') AS f, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')"
    for i, (kind, pattern, group, least) in enumerate(secrets.KINDS)
    for p in [pattern.replace("'", "''")]
)
ORACLES: dict[str, str] = {
    "op2_signature_tree_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])
                                                WHEN len(w) > 0 THEN [array_to_string(w, chr(1))] ELSE [] END) AS g FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
        ), p AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
        ), e AS (
            SELECT a, b FROM l UNION ALL SELECT b, a FROM l
        ), reach AS (
            SELECT doc_id AS id, doc_id AS r FROM w UNION SELECT reach.id, e.b FROM reach JOIN e ON reach.r = e.a
        )
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY id) c USING (doc_id)
    """,
    "op10_secret_ownership": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS o, concat_ws('/', source, lang) AS r FROM documents
        ), k AS ({_KIND_SQL}), x AS (
            SELECT *, unnest(range(1, len(f) + 1)) AS i FROM k
        ), y AS (
            SELECT doc_id, o, r, ord, kind, v[i] AS value, least,
                   (coalesce(list_sum(list_transform(g[1:i], lambda z: length(z))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda z: length(z))), 0))::INT AS s, length(f[i]) AS n FROM x
        ), z AS (
            SELECT *, s + n AS e FROM y WHERE length(value) >= least AND (kind <> 'word' OR regexp_matches(value, '[0-9].*[0-9].*[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]'))
        ), c AS (
            SELECT * FROM z WHERE kind <> 'word' OR NOT EXISTS (SELECT 1 FROM z b WHERE b.doc_id = z.doc_id AND b.kind <> 'word' AND b.s < z.e AND z.s < b.e)
        ), live AS (
            SELECT value, count(DISTINCT o) <= 1 AND count(DISTINCT r) <= 3 AS live FROM c GROUP BY value
        ), j AS (
            SELECT c.*, live FROM c JOIN live USING (value) WHERE live OR kind <> 'word'
        ), a AS (
            SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
                   string_agg(CASE WHEN kind <> 'word' THEN kind || ':' || s || ':' || e END, ',' ORDER BY s, ord) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans,
                   count_if(live) AS n_live, count_if(NOT live) AS n_shared FROM j GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared FROM d LEFT JOIN a USING (doc_id)
    """,
    "op3_pstable_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
        ), u AS (
            SELECT * FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT vec_id AS id, vec_id AS r FROM v
            UNION
            SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a
        ), c AS (
            SELECT id, min(r) AS component_id FROM reach GROUP BY id
        ), d AS (
            SELECT a, count(*) AS n FROM l GROUP BY a
        )
        SELECT v.vec_id, coalesce(d.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
        FROM v JOIN c ON c.id = v.vec_id LEFT JOIN d ON d.a = v.vec_id
    """,
    "op9_legacy_archives": """
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op12_crc_importance_resampling": """
        WITH w AS (
            SELECT id, src, list_filter(string_split_regex(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w
            FROM (SELECT doc_id AS id, text AS t, 0 AS src FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark)
        ), f AS (
            SELECT id, src, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM w
        ), g AS (
            SELECT id, src, f, count(*) AS n FROM f GROUP BY ALL
        ), step AS (
            SELECT list_transform(range(16), lambda v: list_reduce(range(4), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS s
        ), d AS (
            SELECT f, lower(hex(encode(f))) AS h FROM (SELECT DISTINCT f FROM g)
        ), b AS (
            SELECT f, xor(list_reduce(list_transform(range(len(h)), lambda i: instr('0123456789abcdef', h[i + 2 - 2 * (i % 2)]) - 1), lambda c, y: xor(c >> 4, s[(xor(c, y) & 15) + 1]), 4294967295), 4294967295) % 10000 AS b FROM d, step
        ), e AS (
            SELECT id, src, b, sum(n) AS n FROM g JOIN b USING (f) GROUP BY ALL
        ), tot AS (
            SELECT coalesce(sum(n) FILTER (src = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (src = 1), 0)::DOUBLE AS t FROM e
        ), gain AS (
            SELECT b, floor(1000 * ln((coalesce(sum(n) FILTER (src = 1), 0)::DOUBLE + 1) * (tot.s + 10000) / ((coalesce(sum(n) FILTER (src = 0), 0)::DOUBLE + 1) * (tot.t + 10000))))::BIGINT AS g FROM e, tot GROUP BY b, tot.s, tot.t
        ), weight AS (
            SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM e JOIN gain USING (b) WHERE src = 0 GROUP BY id
        ), scored AS (
            SELECT w.id AS doc_id, len(w.w) AS words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
            FROM w LEFT JOIN weight ON weight.id = w.id WHERE src = 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, (SELECT count(*) FROM scored WHERE words >= 20) AS m FROM scored
        )
        SELECT doc_id, words AS n_words, n_features, weight, score, CASE WHEN words >= 20 AND place <= 5 * m // 100 THEN place END AS rank FROM placed
    """,
    "op11_trie_collocations": """
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents
        ), w AS (
            SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p
        ), g AS (
            SELECT lang, unnest(list_transform(w, lambda x: [x]) || list_transform(range(1, len(w)), lambda i: w[i:i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS g FROM w
        ), f AS (
            SELECT lang, g, count(*) AS f FROM g GROUP BY ALL
        ), tot AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang
        ), c AS (
            SELECT * FROM f WHERE len(g) > 1 AND f >= 10
        ), x AS (
            SELECT *, unnest(range(1, len(g))) AS k FROM c
        ), cut AS (
            SELECT x.lang, x.g, x.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * x.f * x.f // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM x JOIN f l ON l.lang = x.lang AND l.g = x.g[1:k] JOIN f r ON r.lang = x.lang AND r.g = x.g[k + 1:]
        ), weak AS (
            SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
        ), longer AS (
            SELECT lang, g, max(f) AS f FROM (SELECT lang, unnest([g[1:2], g[2:3]]) AS g, f FROM c WHERE len(g) = 3) GROUP BY lang, g
        ), kept AS (
            SELECT weak.lang, array_to_string(weak.g, ' ') AS phrase, a, l, r, score, len(weak.g)::INT AS words
            FROM weak LEFT JOIN longer ON longer.lang = weak.lang AND longer.g = weak.g WHERE longer.f IS NULL OR 100 * longer.f < 50 * a
        )
        SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score, words
        FROM kept JOIN tot ON tot.lang = kept.lang QUALIFY rank <= 2000
    """,
}
