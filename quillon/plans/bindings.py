"""Canonical relations derived from the given tables, in Spark and as SQL text for other engines.

There are no image data; predictions, manifests, hashes and batches are integer arithmetic on keys of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDS, FOLDS, REPEATS = 5, 5, 10


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fold(repeat: int | str = 0) -> str:
    return f"(o_custkey * (2 * {repeat} + 3) + {repeat}) % 5"


_LABEL = "CASE WHEN o_orderkey % 37 = 0 OR (o_custkey % 3 = 0 AND o_orderkey % 11 = 0) THEN 1 ELSE 0 END"
#: Columns that both engines read alike.
_MANIFEST = f"""
 concat('img_', CAST(o_orderkey AS STRING)) AS filepath,
 o_orderkey AS image_id,
 CASE WHEN o_custkey % 3 = 0 THEN 'center_2' ELSE 'center_1' END AS centre,
 CAST({_LABEL} AS BIGINT) AS label_int,
 CASE WHEN ({_LABEL}) = 1 THEN 'neoplasia' ELSE 'non-dysplastic' END AS class_label,
 CASE WHEN ({_LABEL}) = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'obvious' WHEN o_orderkey % 3 = 1 THEN 'moderate' ELSE 'would_have_missed' END AS visibility,
 o_custkey AS group_id,
 o_totalprice AS file_size,
 o_custkey % 4 = 0 AS has_redaction,
 o_orderkey % 50 <> 0 AS keep_for_training,
 o_orderpriority AS mode,
 {", ".join(f"CASE WHEN o_orderkey % 50 = 0 THEN -1 ELSE CAST({fold(r)} AS BIGINT) END AS fold_r{r}" for r in range(REPEATS))}"""


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """One row an order: the stand-in for one row an image."""
    return table(spark, d, "orders").selectExpr(*_split(_MANIFEST))


def _split(columns: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(columns[last:i])
            last = i + 1
    return [*out, columns[last:]]


def pred(spark: SparkSession, d: str, *, decimals: int | None = None) -> DataFrame:
    """Predictions of five seeds over the manifest (repeat 0); decimals rounds the scores, which makes ties."""
    logit = "2.0D * label_int + ((image_id * 7919 + seed * 104729) % 10007) / 10007.0D * 4 - 2"
    m = manifest(spark, d).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SEEDS - 1).cast("long"))))
    out = m.selectExpr("filepath", "image_id", "centre", "class_label", "label_int", "visibility", "group_id", "CAST(0 AS BIGINT) AS `repeat`", "fold_r0 AS fold", "seed", f"{logit} AS logit")
    return out.withColumn("logit", F.round("logit", decimals)) if decimals is not None else out


_DUCK = _MANIFEST.replace("STRING", "VARCHAR")
MANIFEST_SQL = f"manifest AS (SELECT {_DUCK} FROM orders)"
_PRED = "SELECT filepath, image_id, centre, class_label, label_int, visibility, group_id, CAST(0 AS BIGINT) AS repeat, fold_r0 AS fold, s AS seed, {logit} AS logit FROM manifest, (SELECT unnest(range(5)) AS s)"
_LOGIT = "2.0::DOUBLE * label_int + ((image_id * 7919 + s * 104729) % 10007) / 10007.0::DOUBLE * 4 - 2"
PRED_SQL = f"{MANIFEST_SQL}, pred AS ({_PRED.format(logit=_LOGIT)})"
TIES_SQL = f"{MANIFEST_SQL}, pred AS ({_PRED.format(logit=f'round({_LOGIT}, 1)')})"


def curve_sql(source: str, by: str, *, score: str = "logit", label: str = "label_int", name: str = "curve") -> str:
    """CTEs that end in `name`: the tie-group curve of a relation, by a comma-separated list of keys."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    group = f"GROUP BY {keys}score"
    return f"""{name}_t AS (SELECT {keys}{score} AS score, sum({label}) AS pos, sum(1 - {label}) AS neg FROM {source} {group.replace('score', score)}),
{name} AS (SELECT {keys}score, pos, neg, sum(pos) OVER ({part} ORDER BY score DESC) AS tp, sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
  sum(pos) OVER ({part}) AS P, sum(neg) OVER ({part}) AS N FROM {name}_t)"""


METRICS_SQL = {
    "roc_auc": "CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(pos * (N - fp + neg / 2.0::DOUBLE)) / (max(P)::DOUBLE * max(N)) END",
    "ap": "CASE WHEN max(P) > 0 AND max(N) > 0 THEN sum(CASE WHEN pos > 0 THEN pos::DOUBLE / P * tp / (tp + fp) END) END",
    "fpr_at_recall": "CASE WHEN max(P) > 0 AND max(N) > 0 THEN max(CASE WHEN pos > 0 AND (tp - pos)::DOUBLE / P <= 0.9 AND tp::DOUBLE / P > 0.9 THEN (fp - neg + (0.9::DOUBLE - (tp - pos)::DOUBLE / P) / (pos::DOUBLE / P) * neg) / N END) END",
    "ppv_at_recall": """CASE WHEN max(P) > 0 AND max(N) > 0 THEN max(CASE WHEN pos > 0 AND (tp - pos)::DOUBLE / P <= 0.9 AND tp::DOUBLE / P > 0.9 THEN
      (CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos)::DOUBLE / (tp - pos + fp - neg) ELSE 1 END)
      + (0.9::DOUBLE - (tp - pos)::DOUBLE / P) / (pos::DOUBLE / P) * (tp::DOUBLE / (tp + fp) - (CASE WHEN tp - pos + fp - neg > 0 THEN (tp - pos)::DOUBLE / (tp - pos + fp - neg) ELSE 1 END)) END) END""",
    "pauc_area": "sum(CASE WHEN neg > 0 AND (fp - neg)::DOUBLE / N < 0.15 THEN (least(fp::DOUBLE / N, 0.15) - (fp - neg)::DOUBLE / N) * (2 * (tp - pos)::DOUBLE / P + (least(fp::DOUBLE / N, 0.15) - (fp - neg)::DOUBLE / N) / (neg::DOUBLE / N) * (pos::DOUBLE / P)) / 2.0 ELSE 0 END)",
    "threshold": "max(CASE WHEN tp >= least(ceil(0.9::DOUBLE * P), P) AND pos > 0 THEN score END)",
    "fpr_attainable": "min(CASE WHEN tp >= least(ceil(0.9::DOUBLE * P), P) THEN fp::DOUBLE / N END)",
}


def dups(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("doc_id", "concat('doc_', lpad(CAST(doc_id AS STRING), 8, '0')) AS filepath", "lang AS class_label", "source AS centre", "sha2(text, 256) AS sha256_hash", "n_chars")


DUPS_SQL = "dups AS (SELECT doc_id, concat('doc_', lpad(CAST(doc_id AS VARCHAR), 8, '0')) AS filepath, lang AS class_label, source AS centre, sha256(text) AS sha256_hash, n_chars FROM documents)"


def codes(spark: SparkSession, d: str) -> DataFrame:
    """embeddings -> vec_id, label, two 64-bit codes: the signs (code), and whether a value exceeds the one before (dcode).

    Ids that end in 7 take the codes of the id seven below them, with a few of the lowest bits turned, so that near codes
    occur at many distances, also across labels.
    """
    sign = lambda condition: F.aggregate(F.transform("embedding", condition), F.expr("0L"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    one, zero = F.expr("1L"), F.expr("0L")
    rises = lambda x, i: F.when(x > F.get("embedding", i - 1), one).otherwise(zero)
    e = table(spark, d, "embeddings").select("vec_id", "label", sign(lambda x, i: F.when(x > 0, one).otherwise(zero)).alias("code"), sign(rises).alias("dcode"))
    source = e.select((F.col("vec_id") + 7).alias("vec_id"), F.col("code").alias("c0"), F.col("dcode").alias("d0")).where("vec_id % 10 = 7")
    turned = lambda own, other, k: F.when(F.col(other).isNull(), F.col(own)).otherwise(F.col(other).bitwiseXOR(F.expr(f"shiftleft(1L, cast({k} as int)) - 1")))
    tens = "floor(vec_id / 10)"
    return e.join(source, "vec_id", "left").select("vec_id", "label", turned("code", "c0", f"{tens} % 17").alias("code"), turned("dcode", "d0", f"({tens} * 7) % 23").alias("dcode"))


_TURN = lambda own, k: f"CASE WHEN o.vec_id IS NULL THEN c.{own} ELSE xor(o.{own}, concat(repeat('0', CAST(64 - {k} AS BIGINT)), repeat('1', CAST({k} AS BIGINT)))::BIT) END"
CODES_SQL = f"""codes0 AS (SELECT vec_id, label, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS code,
  array_to_string(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN i > 1 AND embedding[i] > embedding[i - 1] THEN '1' ELSE '0' END), '')::BIT AS dcode FROM embeddings),
codes AS (SELECT c.vec_id, c.label, {_TURN('code', 'floor(c.vec_id / 10) % 17')} AS code, {_TURN('dcode', '(floor(c.vec_id / 10) * 7) % 23')} AS dcode FROM codes0 c LEFT JOIN codes0 o ON c.vec_id % 10 = 7 AND o.vec_id = c.vec_id - 7)"""


def batches(spark: SparkSession, d: str) -> DataFrame:
    """events in blocks of 32 -> batch, n_items, seconds."""
    e = table(spark, d, "events").withColumn("batch", F.floor(F.col("event_id") / 32).cast("long"))
    return e.groupBy("batch").agg(F.count(F.lit(1)).alias("n_items"), (F.round(F.sum("value"), 4) / 10.0).alias("seconds"))


BATCHES_SQL = "batches AS (SELECT CAST(floor(event_id / 32) AS BIGINT) AS batch, count(*) AS n_items, round(sum(value), 4) / 10.0::DOUBLE AS seconds FROM events GROUP BY 1)"
