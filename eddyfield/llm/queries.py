"""One query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eddyfield.llm import clustering, decontaminate, exactdedup, jaccard, langid, linededup, mixing, negatives, pii, quality, sharding, simhash, urlfilter
from eddyfield.llm.common import held_out, read
from eddyfield.llm.registry import query

OP6_SQL = r"""
WITH texts AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), groups AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM texts JOIN groups USING (text_sha256)
"""


@query("op6_exact_dedup", OP6_SQL)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exactdedup.exact_groups(read(spark, sf_dir, "documents"), digest_all=True)
    return groups.withColumnRenamed("digest", "text_sha256")


@query("op7_sharding")
def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(read(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


OP1_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents
), shares AS MATERIALIZED (
  SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) / sum(sum(tokens)) OVER ()::DOUBLE AS share FROM docs GROUP BY source
), goal AS (
  SELECT 0.95 * ln(count(*)) AS h FROM shares WHERE share > 0
), halving AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1, CASE WHEN e.h <= goal.h THEN low ELSE (low + high) / 2 END, CASE WHEN e.h <= goal.h THEN (low + high) / 2 ELSE high END
  FROM halving, goal, LATERAL (
    SELECT ln(sum(pow(share, (low + high) / 2))) - sum(pow(share, (low + high) / 2) * (low + high) / 2 * ln(share)) / sum(pow(share, (low + high) / 2)) AS h
    FROM shares WHERE share > 0) e
  WHERE i < 25
), extremes AS (
  SELECT max(share) / min(share) AS ratio FROM shares WHERE share > 0
), alpha AS (
  SELECT round(greatest((SELECT high FROM halving WHERE i = 25), 1 - ln(4.0) / ln(ratio), 0.0), 6) AS a FROM extremes
), weights AS MATERIALIZED (
  SELECT source, tokens, pow(share, a) AS power, sum(pow(share, a)) OVER () AS z FROM shares, alpha
), quotas AS MATERIALIZED (
  SELECT source, tokens AS source_tokens, round(power / z, 9) AS weight,
         greatest(CAST(round(round(power / z, 9) * round(max(tokens / power) OVER () * z)) AS BIGINT), tokens) AS quota
  FROM weights
), epochs AS (
  SELECT d.doc_id, d.source, d.tokens, source_tokens, weight, quota, unnest(range(0, 1 + quota // source_tokens)) AS epoch
  FROM docs d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source
), streams AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY source, epoch ORDER BY u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT *, CAST('0x' || substr(md5('7|' || epoch || '|' || doc_id), 1, 15) AS BIGINT) AS u FROM epochs)
), placed AS (
  SELECT doc_id, source, epoch, tokens, CAST(epoch * source_tokens + before AS BIGINT) AS start,
         CAST(floor((epoch * source_tokens + before) / greatest(weight * 1048576.0::DOUBLE, 1.0)) AS BIGINT) AS block
  FROM streams WHERE epoch < quota // source_tokens OR before < quota % source_tokens
)
SELECT *, CAST('0x' || substr(md5('7|' || block || '|' || epoch || '|' || doc_id), 1, 15) AS BIGINT) AS place FROM placed
"""


@query("op1_mixing", OP1_SQL)
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, sources = mixing.plan(read(spark, sf_dir, "documents"))
    return mixing.blocks(rows, sources)


_LISTED = ", ".join(f"'{name}.{end}'" for name in urlfilter.BLOCKED_NAMES for end in urlfilter.ENDINGS)

OP2_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), urls AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM parts
), rules(kind, rule_host, rule_path) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), ruled AS (
  SELECT u.*,
         (SELECT max_by(rule_host || rule_path, length(rule_host || rule_path)) FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS rule,
         (SELECT max_by(kind, length(rule_host || rule_path)) FROM rules
          WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS kind,
         (SELECT max_by(entry, length(entry)) FROM (SELECT unnest([{_LISTED}]) AS entry)
          WHERE entry = host || path OR host = entry OR ends_with(host, '.' || entry)) AS listed
  FROM urls u
)
SELECT page_id, host, path, rule, coalesce(kind, CASE WHEN listed IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, listed FROM ruled
"""


@query("op2_url_filter", OP2_SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(read(spark, sf_dir, "pages"))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(read(spark, sf_dir, "documents"))
    model = quality.learn(measured, read(spark, sf_dir, "labels"))
    scored = measured.withColumn("score", quality.score_of(model))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    judged = docs.select("doc_id", held_out().alias("held_out"), langid.detect(docs, langid.learn(docs)).alias("judged"))
    return judged.select("doc_id", "held_out", F.col("judged.lang").alias("lang_pred"), F.col("judged.score").alias("score"))


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * inter >= 80 * (x.n + y.n - inter)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, b FROM reach JOIN links ON other = a
)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


@query("op10_jaccard_join", OP10_SQL)
def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_groups(read(spark, sf_dir, "documents"))


@query("op8_decontaminate")
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_groups(read(spark, sf_dir, "documents"))


@query("op3_pii")
def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(read(spark, sf_dir, "documents")))


def _kmeans_sql(rounds: int = 5) -> str:
    def assigned(i: int) -> str:
        return f"""a{i} AS MATERIALIZED (
  SELECT vec_id, v, best.cluster AS cluster, best.distance AS distance FROM (
    SELECT vec_id, any_value(v) AS v, min({{'distance': distance, 'cluster': cluster}}) AS best FROM (
      SELECT vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance
      FROM kept, c{i}) GROUP BY vec_id)
)"""

    def moved(i: int) -> str:
        return f"""c{i + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m.c, old.c) AS c FROM c{i} old LEFT JOIN (
    SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, 65) g(i) GROUP BY cluster, i) GROUP BY cluster) m USING (cluster)
)"""

    ctes = [assigned(i) + ",\n" + moved(i) for i in range(rounds)] + [assigned(rounds)]
    return rf"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS INTEGER) AS cluster, v AS c FROM kept ORDER BY cluster LIMIT 40
), {", ".join(ctes)}
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


@query("op11_centroid_clustering", _kmeans_sql())
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


@query("op12_simhash")
def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(read(spark, sf_dir, "documents"))


OP13_SQL = """
WITH part AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM part a JOIN part b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER of AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW of AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER of <= 3
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.prepared(read(spark, sf_dir, "embeddings"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)
