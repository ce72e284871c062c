"""The registered queries of the training-data operators and their SQL.

Each query applies one operator with its production parameters to its whole table and
derives the stated columns from the operator's output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitcart.llm import (bpe, cascade, chunking, common, infill, oph, orc_tokens, pairwise, prefix_free, raking,
                            randomness, resample, url_rules, voronoi)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_voronoi_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi.integer_vectors(table(spark, sf_dir, "embeddings"))
    return voronoi.top_k(vectors.filter(F.col("vec_id") % 50 == 0), vectors, 5)


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pairwise.fit(docs, labels.filter(~pairwise.held_out(F.col("doc_id"))))
    return pairwise.score(docs, model).select("doc_id", pairwise.held_out(F.col("doc_id")).alias("held_out"), "score",
                                              (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.dedup_chunks(table(spark, sf_dir, "documents"))


def op4_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.scratch(spark, "orc-tokens")
    orc_tokens.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return orc_tokens.digests(orc_tokens.read_tokens(spark, path))


def op5_minhash_oph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oph.near_duplicates(table(spark, sf_dir, "documents"))


def op6_bpe_segment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = cascade.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raking.mix(table(spark, sf_dir, "documents"))


def op9_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return prefix_free.digests(docs, prefix_free.remove_repeats(docs))


def op10_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return randomness.find_secrets(table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages")).drop("mined_confidence")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(infill.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_voronoi_top5, op2_bradley_terry_quality, op3_gear_chunk_dedup, op4_orc_token_ids, op5_minhash_oph,
    op6_bpe_segment_tree, op7_rule_cascade, op8_raked_mixture, op9_prefix_free_dedup, op10_randomness_secrets,
    op11_importance_resample, op12_url_association_rules, op13_fill_in_middle)}

ORACLE_SQL: dict[str, str] = {
    "op1_voronoi_top5": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(list_zip(q.x, d.x), lambda p: p[1] * p[2])) AS score
            FROM v q, v d WHERE q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INTEGER) AS rank, CAST(vec_id AS BIGINT) AS vec_id,
               CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 5""",
    "op5_minhash_oph": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        links AS (
            SELECT a, b FROM (
                SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
                GROUP BY ALL) p JOIN n k ON k.doc_id = a JOIN n m ON m.doc_id = b
            WHERE 100 * shared >= 75 * (k.n + m.n - shared)),
        reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.other),
        smallest AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(component_id AS BIGINT) AS component_id,
               d.doc_id = component_id AS kept
        FROM documents d JOIN smallest ON id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op7_rule_cascade": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (
            SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM d),
        windows AS (
            SELECT r, i, list_slice(words, i, i + 2) AS g
            FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
        twins AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
        covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twins, (VALUES (0), (1), (2)) t(k) GROUP BY r),
        stats AS (
            SELECT doc_id, text, len(words) AS n_words, len(lines) AS n_lines,
                   length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                   len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
            FROM w LEFT JOIN covered USING (r)),
        judged AS (
            SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                   10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
                   OR word_chars < 3 * n_words OR word_chars > 12 * n_words
                   OR 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > word_chars
                   OR 2 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > n_words
                   OR 2 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > word_chars
                   OR NOT regexp_matches(text, '\p{L}') AS rejected
            FROM stats)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
               CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
               NOT base_failed AND NOT rejected AS kept
        FROM judged""",
    "op11_importance_resample": r"""
        WITH words AS (
            SELECT src, r, id, list_filter(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM (SELECT 'd' AS src, row_number() OVER () AS r, doc_id AS id, text FROM documents
                  UNION ALL SELECT 'b', row_number() OVER (), item_id, text FROM benchmark)),
        runs AS (
            SELECT src, r, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, count(*) AS n
            FROM (SELECT src, r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k)
            GROUP BY ALL),
        bytes AS (SELECT g, CAST(encode(g) AS BIT) AS b, 8 * octet_length(encode(g)) AS bits FROM (SELECT DISTINCT g FROM runs)),
        hashed AS (
            SELECT g, xor(list_reduce(list_transform(range(bits), lambda i: CAST(get_bit(b, CAST(i - i % 8 + 7 - i % 8 AS INTEGER)) AS BIGINT)),
                          lambda c, x: xor(c >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295), 4294967295) % 10000 AS bucket
            FROM bytes),
        features AS (SELECT src, r, bucket, sum(n) AS n FROM runs JOIN hashed USING (g) GROUP BY ALL),
        counts AS (
            SELECT bucket, coalesce(sum(n) FILTER (src = 'd'), 0) AS s, coalesce(sum(n) FILTER (src = 'b'), 0) AS t FROM features GROUP BY 1),
        totals AS (SELECT CAST(sum(s) AS DOUBLE) AS ss, CAST(sum(t) AS DOUBLE) AS tt FROM counts),
        gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS gain FROM counts, totals),
        weights AS (SELECT r, sum(n) AS n_features, sum(n * gain) AS weight FROM features JOIN gain USING (bucket) WHERE src = 'd' GROUP BY 1),
        scored AS (
            SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT)
                       + 0.5) / 4294967296))) AS score
            FROM words LEFT JOIN weights USING (r) WHERE src = 'd'),
        drawn AS (
            SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features, weight) END AS place
            FROM scored)
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
               CASE WHEN place <= floor(5 * (SELECT count(*) FROM scored WHERE n_words >= 20) / 100) THEN CAST(place AS BIGINT) END AS rank
        FROM drawn""",
    # urls of more than 12 items would need the bound that mining has; the given tables have none
    "op12_url_association_rules": r"""
        WITH parts AS (
            SELECT r, page_id, url, scheme, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path, rest FROM (
                SELECT *, substr(tail, length(path) + 1) AS rest FROM (
                    SELECT *, regexp_extract(tail, '^[^?#]*') AS path FROM (
                        SELECT *, substr(after, length(host) + 1) AS tail FROM (
                            SELECT *, regexp_extract(after, '^[^/?#]*') AS host FROM (
                                SELECT row_number() OVER () AS r, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS after,
                                       CASE WHEN strpos(url, '://') > 0 THEN substr(url, 1, strpos(url, '://') - 1) ELSE '' END AS scheme
                                FROM pages)))))),
        rules(verdict, site, start) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                             ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
        fits AS (
            SELECT r, arg_max(site || start, length(site || start)) AS rule, arg_max(verdict, length(site || start)) AS stated
            FROM parts JOIN rules ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY 1),
        toks AS (
            SELECT DISTINCT r, tok FROM (
                SELECT r, 'scheme:' || lower(scheme) AS tok FROM parts WHERE scheme <> ''
                UNION ALL SELECT r, 'host:' || x FROM (SELECT r, unnest(string_split(regexp_replace(host, '[0-9]+', '0', 'g'), '.')) AS x FROM parts) WHERE x <> ''
                UNION ALL SELECT r, 'path:' || x FROM (SELECT r, unnest(regexp_split_to_array(regexp_replace(lower(path), '[0-9]+', '0', 'g'), '[/._-]+')) AS x FROM parts) WHERE x <> ''
                UNION ALL SELECT r, 'rest:' || x FROM (SELECT r, unnest(regexp_split_to_array(regexp_replace(lower(rest), '[0-9]+', '0', 'g'), '[?#&=]+')) AS x FROM parts) WHERE x <> '')),
        learn AS (SELECT min(r) AS r, stated AS label FROM parts JOIN fits USING (r) GROUP BY url, stated),
        total AS (SELECT count(*) AS n FROM learn),
        covers AS (SELECT tok, list(r ORDER BY r) AS cover FROM toks JOIN learn USING (r) GROUP BY 1),
        items AS (SELECT min(tok) AS item, list(tok ORDER BY tok) AS toks, cover FROM covers WHERE len(cover) < (SELECT n FROM total) GROUP BY cover),
        sets AS (SELECT r, label, list(item ORDER BY item) AS items FROM learn JOIN toks USING (r) JOIN items ON item = tok GROUP BY 1, 2),
        subsets AS (
            SELECT r, label, list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS s
            FROM (SELECT r, label, items, unnest(range(1, CAST(1 AS BIGINT) << len(items))) AS mask FROM sets)),
        counted AS (SELECT s, label, count(*) AS support, sum(count(*)) OVER (PARTITION BY s) AS n FROM subsets GROUP BY s, label),
        mined AS (
            SELECT s, label, support, support / counted.n AS confidence FROM counted, total
            WHERE support >= greatest(1, ceil(0.01 * total.n)) AND support / counted.n >= 0.6),
        wanted AS (SELECT s, label, support, confidence, list_sort(flatten(list(toks))) AS toks
                   FROM (SELECT *, unnest(s) AS item FROM mined) JOIN items USING (item) GROUP BY 1, 2, 3, 4),
        all_toks AS (SELECT r, list(tok) AS has FROM toks GROUP BY 1),
        best AS (
            SELECT r, arg_max(label, (confidence, support, label = 'block')) AS mined
            FROM all_toks JOIN wanted ON list_has_all(has, toks) GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(stated, mined, 'allow') AS verdict
        FROM parts LEFT JOIN fits USING (r) LEFT JOIN best USING (r)""",
    "op13_fill_in_middle": r"""
        WITH d AS (
            SELECT doc_id, text, toks, len(toks) AS n, list_transform(range(4), lambda i:
                       CAST('0x' || substr(digest, CAST(8 * i + 1 AS INTEGER), 8) AS BIGINT)) AS h
            FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS toks,
                         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents)),
        cuts AS (
            SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                        WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
        parts AS (
            SELECT *, array_to_string(list_slice(toks, 1, a), '') AS prefix, array_to_string(list_slice(toks, a + 1, b), '') AS middle,
                   array_to_string(list_slice(toks, b + 1, n), '') AS suffix FROM cuts)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
}


def all_queries() -> dict:
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
