"""The queries opN_<name>: each operator, with production parameters, over its whole table, as the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dialogues, edits, importance, mixing, near_dup, packing, pages, quality, secrets, sharding, toxicity, urls
from .common import read


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("base", secrets.of_kind(k))).cast("long").alias(f"n_{name}") for k, (name, *_) in enumerate(secrets.BASE)]
    return out.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.report(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.fingerprint(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    return dialogues.repair(dialogues.damaged(turns), turns)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_near_dup": op2_near_dup,
        "op3_url_filter": op3_url_filter,
        "op4_secrets": op4_secrets,
        "op5_quality": op5_quality,
        "op6_decontaminate": op6_decontaminate,
        "op7_sharding": op7_sharding,
        "op8_toxicity": op8_toxicity,
        "op9_fingerprints": op9_fingerprints,
        "op10_mixing": op10_mixing,
        "op11_dialogue_repair": op11_dialogue_repair,
        "op12_importance": op12_importance,
        "op13_packing": op13_packing,
    }


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP3 = r"""
WITH p AS (
  SELECT page_id, url, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), {az}) AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p),
v AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule,
         ('0x' || substr(md5(coalesce(url, '')), 1, 4))::BIGINT % 4 = 0 AS apart,
         repeat(chr(2), 4) || regexp_replace(translate(coalesce(url, ''), {az}), '[^\x21-\x7E]', '~', 'g') || chr(3) AS padded
  FROM r),
g AS (SELECT page_id, by_rule, apart, unnest(list_transform(range(1, length(padded) - 3), lambda i: substr(padded, i, 5))) AS gram FROM v),
t AS (SELECT gram, sum(CASE WHEN by_rule = 'allow' AND NOT apart THEN 1 ELSE 0 END) AS a, sum(CASE WHEN by_rule = 'block' AND NOT apart THEN 1 ELSE 0 END) AS b FROM g GROUP BY gram),
m0 AS (SELECT gram, a, b, (sum(a) OVER (PARTITION BY substr(gram, 5, 1)) + 4.0 / 97) / (sum(a) OVER () + 4.0) AS pa,
              (sum(b) OVER (PARTITION BY substr(gram, 5, 1)) + 4.0 / 97) / (sum(b) OVER () + 4.0) AS pb FROM t),
{levels}
s AS (SELECT page_id, CASE WHEN bool_and(apart) THEN any_value(by_rule) END AS by_rule, sum(round((ln(pa) - ln(pb)) * 1000000)) / count(*) / 1000000 AS score
      FROM g JOIN m4 USING (gram) GROUP BY page_id),
c AS (SELECT avg(score) FILTER (by_rule = 'allow') AS ma, avg(score) FILTER (by_rule = 'block') AS mb,
             stddev_pop(score) FILTER (by_rule = 'allow') AS sa, stddev_pop(score) FILTER (by_rule = 'block') AS sb FROM s)
SELECT v.page_id, host, path, rule,
       coalesce(v.by_rule, CASE WHEN score >= coalesce(round(mb + CASE WHEN sa + sb > 0 THEN sb / (sa + sb) ELSE 0.5 END * (ma - mb), 6), 0) THEN 'allow' ELSE 'block' END) AS verdict
FROM v JOIN s USING (page_id) CROSS JOIN c
"""
_LEVEL = """m{k} AS (SELECT gram, a, b, (sum(a) OVER (PARTITION BY substr(gram, {s}, {n})) + 4.0 * pa) / (sum(a) OVER (PARTITION BY substr(gram, {s}, {k})) + 4.0) AS pa,
              (sum(b) OVER (PARTITION BY substr(gram, {s}, {n})) + 4.0 * pb) / (sum(b) OVER (PARTITION BY substr(gram, {s}, {k})) + 4.0) AS pb FROM m{j}),"""

_OP4 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT * FROM (VALUES
  (0, 'assign', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]{12,})$'),
  (1, 'access', 'AKIA[A-Z0-9]+', '^.{18,}$'), (2, 'hex', '[0-9a-f]+', '^.{16,}$'), (3, 'entropy', '[A-Za-z0-9+/_=-]+', '^.{20,}$')) AS t(k, kind, pattern, needs)),
raw AS (
  SELECT doc_id, k, kind, needs, m, list_transform(string_split_regex(text, pattern), lambda x: length(x)) AS gaps
  FROM (
    SELECT doc_id, text, 0 AS k, regexp_extract_all(text, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS m FROM d
    UNION ALL SELECT doc_id, text, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
    UNION ALL SELECT doc_id, text, 2, regexp_extract_all(text, '[0-9a-f]+') FROM d
    UNION ALL SELECT doc_id, text, 3, regexp_extract_all(text, '[A-Za-z0-9+/_=-]+') FROM d) JOIN p USING (k)
  WHERE len(m) > 0),
flat AS (SELECT doc_id, k, kind, needs, unnest(m) AS m, unnest(gaps[1:len(m)]) AS gap, unnest(range(len(m))) AS i FROM raw),
pos AS (
  SELECT doc_id, k, kind, needs, m, (sum(gap + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) - length(m))::BIGINT AS s FROM flat),
ok AS (SELECT doc_id, k, kind, m, s, s + length(m) AS e FROM pos WHERE regexp_matches(m, needs)),
cand AS (
  SELECT * FROM ok WHERE k = 3 AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')
    AND NOT regexp_matches(m, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')
    AND regexp_matches(m, '[A-Za-z][0-9]|[0-9][A-Za-z]')
    AND NOT regexp_matches(m, '(EXAMPLE|example|XXXX|xxxx|1234567890|0123456789|abcdefgh)')
    AND NOT EXISTS (SELECT 1 FROM ok b WHERE b.doc_id = ok.doc_id AND b.k < 3 AND b.s < ok.e AND ok.s < b.e)),
ent AS (
  SELECT doc_id, k, kind, m, s, e FROM (
    SELECT c.*, max(list_aggregate(string_split(substr(m, i, 20), ''), 'entropy')) OVER (PARTITION BY doc_id, s) AS bits
    FROM cand c, unnest(range(1, length(m) - 18)) AS t(i)) WHERE bits >= CASE WHEN regexp_matches(m, '^([0-9a-f]+|[0-9A-F]+)$') THEN 2.9
      WHEN regexp_matches(m, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 3.4 ELSE 3.6 END GROUP BY ALL),
spans AS (SELECT * FROM ok WHERE k < 3 UNION ALL SELECT * FROM ent),
agg AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN agg USING (doc_id)
"""

_OP6 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS words
  FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(s) WHERE len(w) > 0),
widths AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS words
  FROM d, widths, unnest(range(1, len(w) - n + 2)) AS t(s)),
h AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, words)),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id),
p AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM h, unnest(range(s, s + n)) AS t(pos) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN i USING (doc_id) LEFT JOIN p USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    levels = "\n".join(_LEVEL.format(k=k, j=k - 1, n=k + 1, s=5 - k) for k in range(1, 5))
    return {"op3_url_filter": _OP3.format(az=_AZ, levels=levels), "op4_secrets": _OP4, "op6_decontaminate": _OP6.format(az=_AZ)}
