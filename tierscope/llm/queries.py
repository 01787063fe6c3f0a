"""The queries of this package, for the driver's contract: name to function of (spark, sf_dir), and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bpe, exact_dedup, fill_in_middle, html_text, language_model, neighbours, packing, prefix_trie, simhash, suffix_dedup, toxicity, url_filters, warc
from .shared import table


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"))


def op1_warc(spark, sf_dir):
    index = warc.archive(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark, sf_dir):
    return toxicity.severities(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language_model(spark, sf_dir):
    return language_model.score(table(spark, sf_dir, "documents"))


#: Host, path, verdict of the rules that every URL is judged by.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op12_fill_in_middle(spark, sf_dir):
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    text = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_simhash": op3_simhash,
    "op4_packing": op4_packing,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_text": op6_html_text,
    "op7_neighbours": op7_neighbours,
    "op8_toxicity": op8_toxicity,
    "op9_bpe": op9_bpe,
    "op10_language_model": op10_language_model,
    "op11_url_filters": op11_url_filters,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first_id, sha1(html) AS hexed FROM p)
        SELECT page_id,
               strlen(html) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   (1 + ((CAST('0x' || substr(hexed, CAST(10 * (i // 8) + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INTEGER)) & 31))::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM f
    """,
    "op7_neighbours": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_distance(q.e, c.e) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_url_filters": """
        WITH r AS (SELECT unnest(['org', 'example.org', 'example.org', 'com', 'com']) AS rule_host, unnest(['/', '/es/', '/en/1', '/fr/', '/de/']) AS rule_path,
                          unnest(['allow', 'block', 'block', 'allow', 'block']) AS verdict),
             u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
             p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
             b AS (SELECT n, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
                   FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (n)
    """,
    "op12_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS x FROM documents),
             l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, list_transform(range(4), lambda i: CAST('0x' || substr(x, CAST(8 * i + 1 AS BIGINT), 8) AS BIGINT)) AS h FROM d),
             c AS (SELECT *, len(lines) AS n, least(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS a, greatest(h[1] % (len(lines) + 1), h[2] % (len(lines) + 1)) AS b FROM l),
             t AS (SELECT doc_id, n, text, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:n], '') AS suffix,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
        SELECT doc_id, n, form,
               CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM t
    """,
    "op13_prefix_trie": """
        WITH t AS (SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, length(coalesce(text, '')) AS size,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
                   FROM conversations WHERE conv_id IS NOT NULL),
             c AS (SELECT conv_id, list({'x': x, 'size': size} ORDER BY place) AS own,
                          xor(list_reduce(list_transform(range(length(CAST(conv_id AS VARCHAR)) + 1),
                                  lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT) END),
                              lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 6 AS h
                   FROM t GROUP BY conv_id),
             p AS (SELECT c.conv_id, list_concat(coalesce(b.own[1:c.h], []), c.own[c.h + 1:]) AS turns FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
             paths AS (SELECT conv_id, len(turns) = d AS ended, d AS depth, list_transform(turns[1:d], lambda y: y.x) AS node, coalesce(turns[d].size, 0) AS size
                       FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM p)),
             nodes AS (SELECT depth, node, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, count(*) FILTER (ended) AS n_ended,
                              sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends_sha256
                       FROM paths GROUP BY depth, node),
             kids AS (SELECT node[1:depth - 1] AS node, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
             whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (node, depth)),
             up AS (SELECT node[1:d] AS node, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
                    FROM (SELECT *, unnest(range(depth + 1)) AS d FROM whole) GROUP BY ALL)
        SELECT w.conv_id, w.depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
        FROM whole w JOIN up USING (node, depth) LEFT JOIN nodes q ON w.depth > 0 AND q.depth = w.depth - 1 AND q.node = w.node[1:w.depth - 1]
    """,
}
