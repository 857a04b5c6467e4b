"""Registered queries of the training-data operators, each over its whole table, and SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, fingerprint, language, mixing, near_dedup, neighbours, packing, passages, periods, pii, quality, rules, toxicity


def _docs(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_docs(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_docs(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_docs(spark, sf_dir), _docs(spark, sf_dir, "labels"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(_docs(spark, sf_dir)).drop("d2")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "kept")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_docs(spark, sf_dir))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_docs(spark, sf_dir))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_docs(spark, sf_dir))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(_docs(spark, sf_dir), plant=True)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(_docs(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_language": op2_language,
    "op3_quality": op3_quality,
    "op4_passages": op4_passages,
    "op5_toxicity": op5_toxicity,
    "op6_rules": op6_rules,
    "op7_packing": op7_packing,
    "op8_near_dedup": op8_near_dedup,
    "op9_pii": op9_pii,
    "op10_fingerprint": op10_fingerprint,
    "op11_alignment": op11_alignment,
    "op12_periods": op12_periods,
    "op13_neighbours": op13_neighbours,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {
    "op1_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, ratio) FILTER (level <= ratio) AS water FROM l),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(water * weight, cap)) AS target FROM l, v),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size END AS rate FROM t),
u AS (SELECT d.doc_id, d.source, d.size, j, CAST('0x' || substr(md5(j || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS x
  FROM d, range(16) g(j)),
c AS (SELECT q.source, j, abs(q.target - floor(q.rate) * q.source_size - sum(CASE WHEN x < q.rate - floor(q.rate) THEN size ELSE 0 END)) AS off
  FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source GROUP BY q.source, q.target, q.rate, q.source_size, j),
b AS (SELECT source, arg_min(j, (off, j)) AS seed FROM c GROUP BY 1)
SELECT u.doc_id, u.size, q.source_size, q.target, CAST(u.size * (floor(q.rate) + CASE WHEN x < q.rate - floor(q.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source JOIN b ON b.source IS NOT DISTINCT FROM q.source AND b.seed = u.j""",
    "op8_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, w.doc_id = m.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN m ON m.id = w.doc_id""",
}
