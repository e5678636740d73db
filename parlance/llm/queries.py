"""The thin queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import (
    align, decontaminate, exact_dedup, hmm_score, jaccard_join, language_id, line_dedup, mixing, near_vectors, secret_scan, token_counts, url_filter, whitening,
)
from parlance.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = url_filter.filter_urls(spark, table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_contamination(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items, "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")  # other columns may have the report's names
    out = line_dedup.drop_boilerplate(spark, docs, report=True)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard_join.join_similar(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "class_id", "class_size", "n_links", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup_exact(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    base = F.filter("spans", lambda x: x["kind"] != "entropy")

    def count(kind):
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in secret_scan.KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score.score_documents(spark, table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language_id.identify(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "entropy")


def op11_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.link_vectors(spark, table(spark, sf_dir, "embeddings"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(spark, table(spark, sf_dir, "embeddings"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(groups):
        return F.coalesce(F.sha2(groups, 256), F.lit(""))

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    out = align.align(spark, table(spark, sf_dir, "documents"), *paths, shape=digest)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_token_counts": op2_token_counts,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_lm_score": op9_lm_score,
    "op10_language_id": op10_language_id,
    "op11_near_vectors": op11_near_vectors,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

_SITES = ", ".join(f"('{h}{p}')" for h, p, _ in url_filter.BLOCKED_SITES)

ORACLE_SQL: dict[str, str] = {
    "op1_url_filters": f"""
WITH r(host, path, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                      ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
b(key) AS (VALUES {_SITES}),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
hit AS (SELECT page_id, r.host || r.path AS rule, action FROM h JOIN r
        ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path)),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action FROM hit GROUP BY page_id),
bad AS (SELECT DISTINCT page_id FROM h JOIN b ON (h.host || '/' = b.key OR ends_with(h.host || '/', '.' || b.key)) AND starts_with(h.path, '/'))
SELECT h.page_id, h.host, h.path, best.rule,
       coalesce(best.action, CASE WHEN bad.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best ON h.page_id = best.page_id LEFT JOIN bad ON h.page_id = bad.page_id""",
    "op3_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT item, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM p)),
dw AS (SELECT rid, n, i, array_to_string(w[i + 1 : i + n], ' ') AS g
       FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM p) s WHERE len(w) >= n)),
h AS (SELECT rid, item, i, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
x AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM h) GROUP BY rid),
y AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN x ON d.rid = x.rid LEFT JOIN y ON d.rid = y.rid""",
    "op4_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
l AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM l),
s AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
c AS (SELECT source, bare, count(DISTINCT rid) AS n FROM k WHERE bare <> '' GROUP BY source, bare),
x AS (SELECT c.source, c.bare FROM c JOIN s ON c.source IS NOT DISTINCT FROM s.source WHERE n > 1 AND n > {line_dedup.RATIO}::DOUBLE * pages),
m AS (SELECT k.*, x.bare IS NOT NULL AS gone FROM k LEFT JOIN x ON k.source IS NOT DISTINCT FROM x.source AND k.bare = x.bare),
g AS (SELECT rid, count(*) AS n_lines, count_if(gone) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text FROM m GROUP BY rid)
SELECT d.doc_id, coalesce(g.n_lines, 0)::BIGINT AS n_lines, coalesce(g.n_dropped, 0)::BIGINT AS n_dropped, sha256(coalesce(g.text, '')) AS text_sha256
FROM d LEFT JOIN g ON d.rid = g.rid""",
    "op5_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT rid, w, least(5, len(w)) AS n FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT rid, array_to_string(w[i + 1 : i + n], ' ') AS g FROM (SELECT rid, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM p)),
z AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS n FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN z zx ON zx.rid = x JOIN z zy ON zy.rid = y WHERE 10 * c.n >= 8 * (zx.n + zy.n - c.n)),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT r.x AS rid, min(e.doc_id) AS class_id, count(*) AS class_size, arg_min(e.rid, (e.doc_id, e.rid)) AS head FROM r JOIN d e ON r.y = e.rid GROUP BY r.x),
k AS (SELECT x AS rid, count(*) AS n_links FROM l GROUP BY x)
SELECT d.doc_id, m.class_id, m.class_size, coalesce(k.n_links, 0) AS n_links, m.head = d.rid AS kept
FROM d JOIN m ON d.rid = m.rid LEFT JOIN k ON d.rid = k.rid""",
    "op6_mixing": r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('6:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::BIGINT AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS place,
             (sum(source_size) OVER ())::BIGINT AS total, (sum(weight) OVER ())::BIGINT AS all_weight FROM w),
p AS (SELECT *, total - coalesce(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_size,
             all_weight - coalesce(sum(weight) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_weight FROM o),
f AS (SELECT place, left_size, left_weight FROM p WHERE weight * left_size <= 3 * source_size * left_weight ORDER BY place LIMIT 1),
t AS (SELECT p.source, p.source_size, CASE WHEN f.place IS NOT NULL AND p.place >= f.place
             THEN (p.weight * f.left_size)::DOUBLE / f.left_weight::DOUBLE ELSE (3 * p.source_size)::DOUBLE END AS target FROM p LEFT JOIN f ON true),
q AS (SELECT d.*, t.source_size, t.target, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS reach
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT doc_id, size, (n * source_size + reach)::DOUBLE / target AS f FROM q, (VALUES (0), (1), (2)) v(n) WHERE target > 0 AND size > 0),
r AS (SELECT f, sum(size) OVER (ORDER BY f RANGE UNBOUNDED PRECEDING) AS spent FROM e),
cut AS (SELECT max(f) AS f FROM r WHERE spent <= (SELECT sum(size) FROM d))
SELECT q.doc_id, q.size, q.source_size, q.target,
       (q.size * CASE WHEN q.target > 0 AND q.size > 0 THEN (SELECT count(*) FROM (VALUES (0), (1), (2)) v(n)
                 WHERE (n * q.source_size + q.reach)::DOUBLE / q.target <= cut.f) ELSE 0 END)::BIGINT AS taken
FROM q, cut""",
    "op7_exact_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
k AS (SELECT *, first_value(rid) OVER w AS keep_rid, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text) AS group_size
      FROM d WINDOW w AS (PARTITION BY text ORDER BY doc_id DESC NULLS LAST, rid DESC))
SELECT doc_id, keep_id, group_size, rid = keep_rid AS kept, sha256(text) AS text_sha256 FROM k""",
    "op11_near_vectors": f"""
WITH RECURSIVE e AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
g AS MATERIALIZED (SELECT rid, list_transform(v, lambda c: coalesce(c, 0)) AS v FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT a.rid AS x, b.rid AS y FROM g a JOIN g b ON len(a.v) = len(b.v) AND a.rid <> b.rid AND list_cosine_similarity(a.v, b.v) >= {near_vectors.THRESHOLD}::DOUBLE),
r(x, y) AS (SELECT rid, rid FROM e UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT r.x AS rid, min(e.vec_id) AS component_id FROM r JOIN e ON r.y = e.rid GROUP BY r.x),
k AS (SELECT x AS rid, count(*) AS n_links FROM l GROUP BY x)
SELECT e.vec_id, coalesce(k.n_links, 0)::BIGINT AS n_links, m.component_id, e.vec_id IS NOT DISTINCT FROM m.component_id AS kept
FROM e JOIN m ON e.rid = m.rid LEFT JOIN k ON e.rid = k.rid""",
}
