"""Ranking metrics, ranks, spreads and prior equalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import count_if, finite, r6
from ..operators import ranking as R
from ..operators import windows as WN
from ..operators.spread import noise_floor, spread
from ..operators.strata import kish, prior_equalised, prior_weights, stratum_fpr
from .bindings import METRICS_SQL as M
from .bindings import PRED_SQL, TIES_SQL, curve_sql, pred
from .registry import query

BY = ["centre", "seed"]
_CURVE = curve_sql("pred", "centre, seed")


def _metric(name, column, alias, *, ties=False, sql):
    with_ = TIES_SQL if ties else PRED_SQL

    @query(name, f"WITH {with_}, {_CURVE} SELECT centre, seed, round({sql}, 6) AS {alias} FROM curve GROUP BY centre, seed")
    def run(spark, d):
        p = pred(spark, d, decimals=1 if ties else None)
        return R.curve(p, BY).groupBy(*BY).agg(r6(column()).alias(alias))


_metric("m01_roc_auc", R.auc, "roc_auc", sql=M["roc_auc"])
_metric("m01_roc_auc_ties", R.auc, "roc_auc", ties=True, sql=M["roc_auc"])
_metric("m03_fpr_interp", R.fpr_interp, "fpr_at_recall", sql=M["fpr_at_recall"])
_metric("m03_fpr_interp_ties", R.fpr_interp, "fpr_at_recall", ties=True, sql=M["fpr_at_recall"])
_metric("m04_ppv_interp", R.ppv_interp, "ppv_at_recall", sql=M["ppv_at_recall"])
_metric("m04_ppv_interp_ties", R.ppv_interp, "ppv_at_recall", ties=True, sql=M["ppv_at_recall"])
_metric("m05_threshold_at_recall", R.threshold, "threshold", sql=M["threshold"])
_metric("m09_average_precision", R.average_precision, "ap", sql=M["ap"])
_metric("m09_average_precision_ties", R.average_precision, "ap", ties=True, sql=M["ap"])
_metric("m06_fpr_attainable", R.fpr_attainable, "fpr", sql=M["fpr_attainable"])


@query(
    "m02_partial_auc",
    f"""WITH {TIES_SQL}, {_CURVE}, a AS (SELECT centre, seed, {M['pauc_area']} AS area FROM curve GROUP BY centre, seed)
SELECT centre, seed, round(area / 0.15, 6) AS raw, round(0.5 * (1 + (area - 0.15::DOUBLE * 0.15 / 2) / (0.15::DOUBLE - 0.15::DOUBLE * 0.15 / 2)), 6) AS mcclish FROM a""",
)
def m02(spark, d):
    raw, std = R.partial_auc()
    return R.curve(pred(spark, d, decimals=1), BY).groupBy(*BY).agg(r6(raw).alias("raw"), r6(std).alias("mcclish"))


@query(
    "m06_stratum_fpr",
    f"""WITH {PRED_SQL}, {curve_sql('pred', 'seed')}, t AS (SELECT seed, {M['threshold']} AS thr FROM curve GROUP BY seed),
s AS (SELECT p.seed, centre, avg(CASE WHEN logit >= thr THEN 1.0::DOUBLE ELSE 0 END) FILTER (label_int = 0) AS fpr, max(thr) AS thr FROM pred p JOIN t ON p.seed = t.seed GROUP BY p.seed, centre)
SELECT seed, centre, round(fpr, 6) AS fpr, round(thr, 6) AS threshold,
  round(CASE WHEN count(*) OVER (PARTITION BY seed) > 1 THEN max(fpr) OVER (PARTITION BY seed) - min(fpr) OVER (PARTITION BY seed) END, 6) AS asymmetry FROM s""",
)
def m06(spark, d):
    return stratum_fpr(pred(spark, d), ["seed"], "centre").select("seed", "centre", r6("fpr").alias("fpr"), r6("threshold").alias("threshold"), r6("asymmetry").alias("asymmetry"))


_WEIGHTS = """c AS (SELECT centre, sum(label_int) AS n_pos, sum(1 - label_int) AS n_neg FROM pred WHERE seed = 0 GROUP BY centre),
w AS (SELECT centre, CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg, n_neg::DOUBLE / n_pos AS ratio, min(n_neg::DOUBLE / n_pos) OVER () * n_pos / n_neg AS weight FROM c)"""


@query("m07_prior_weights", f"WITH {PRED_SQL}, {_WEIGHTS} SELECT centre, n_pos, n_neg, round(ratio, 6) AS ratio, round(weight, 6) AS weight FROM w")
def m07(spark, d):
    return prior_weights(pred(spark, d).where("seed = 0"), "centre").select("centre", "n_pos", "n_neg", r6("ratio").alias("ratio"), r6("weight").alias("weight"))


@query(
    "m08_prior_equalised_fpr",
    f"""WITH {PRED_SQL}, {_WEIGHTS}, {curve_sql('pred', 'seed')}, t AS (SELECT seed, {M['threshold']} AS thr FROM curve GROUP BY seed)
SELECT p.seed, round(sum(CASE WHEN logit >= thr THEN weight ELSE 0 END) / sum(weight), 6) AS fpr, round(sum(weight), 6) AS effective_n,
  round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS kish FROM pred p JOIN t ON p.seed = t.seed JOIN w ON p.centre = w.centre WHERE label_int = 0 GROUP BY p.seed""",
)
def m08(spark, d):
    p = pred(spark, d)
    weights = prior_weights(p.where("seed = 0"), "centre")
    return prior_equalised(p, ["seed"], "centre", weights).select("seed", r6("fpr").alias("fpr"), r6("effective_n").alias("effective_n"), r6("kish").alias("kish"))


@query(
    "m10_operating_point",
    f"""WITH {TIES_SQL}, {_CURVE} SELECT centre, seed, CAST(max(ceil(0.9::DOUBLE * P)) AS BIGINT) AS tp_ceil, CAST(max(floor(0.9::DOUBLE * P)) AS BIGINT) AS tp_floor,
round(min(CASE WHEN tp >= ceil(0.9::DOUBLE * P) THEN fp::DOUBLE / N END), 6) AS fpr_ceil, round(min(CASE WHEN tp >= floor(0.9::DOUBLE * P) THEN fp::DOUBLE / N END), 6) AS fpr_floor,
round(max(1.0::DOUBLE / P), 6) AS recall_step, round(max(1.0::DOUBLE / N), 6) AS fpr_step FROM curve GROUP BY centre, seed""",
)
def m10(spark, d):
    parts = R.operating_point()
    return R.curve(pred(spark, d, decimals=1), BY).groupBy(*BY).agg(*[(c if k.startswith("tp") else r6(c)).alias(k) for k, c in parts.items()])


def _block_sql(by: str, source: str = "pred", name: str = "block") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{curve_sql(source, by, name=name + '_c')}, {name} AS (SELECT {keys}CAST(max(P) + max(N) AS BIGINT) AS n, CAST(max(P) AS BIGINT) AS n_pos, {M['roc_auc']} AS roc_auc,
  {M['fpr_at_recall']} AS fpr_at_recall, {M['ppv_at_recall']} AS ppv_at_recall, {M['ap']} AS ap FROM {name}_c {group})"""


_BLOCK_COLUMNS = ["n", "n_pos", "roc_auc", "fpr_at_recall", "ppv_at_recall", "ap"]
_BLOCK_OUT = "n, n_pos, round(roc_auc, 6) AS roc_auc, round(fpr_at_recall, 6) AS fpr_at_recall, round(ppv_at_recall, 6) AS ppv_at_recall, round(ap, 6) AS ap"


def _block(df, by):
    return R.metric_block(df, by).select(*by, "n", "n_pos", *[r6(c).alias(c) for c in _BLOCK_COLUMNS[2:]])


@query("m11_metric_block", f"WITH {TIES_SQL}, {_block_sql('centre')} SELECT centre, {_BLOCK_OUT} FROM block")
def m11(spark, d):
    return _block(pred(spark, d, decimals=1), ["centre"])


@query("m12_ppv_projection", f"WITH {PRED_SQL}, {_block_sql('seed')} SELECT seed, round(0.9 * 232 / (0.9 * 232 + fpr_at_recall * 23176), 6) AS ppv_projected FROM block")
def m12(spark, d):
    return R.metric_block(pred(spark, d), ["seed"]).select("seed", r6("ppv_projected").alias("ppv_projected"))


@query("m13_epoch_metrics", f"WITH {PRED_SQL}, {_block_sql('seed')} SELECT seed, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS ap FROM block")
def m13(spark, d):
    return R.metric_block(pred(spark, d), ["seed"]).select("seed", r6("roc_auc").alias("roc_auc"), r6("ap").alias("ap"))


@query("m14_level1", f"WITH {PRED_SQL}, kept AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('seed, fold', 'kept')} SELECT seed, fold, {_BLOCK_OUT} FROM block")
def m14(spark, d):
    return _block(pred(spark, d).where("fold >= 0"), ["seed", "fold"])


@query("m15_level2", f"WITH {PRED_SQL}, kept AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('repeat, seed', 'kept')} SELECT repeat, seed, {_BLOCK_OUT} FROM block")
def m15(spark, d):
    return _block(pred(spark, d).where("fold >= 0"), ["repeat", "seed"])


def _spread_sql(x: str) -> str:
    q = lambda p: f"quantile_cont({x}, {p})"
    return f"""count({x}) AS n, round({q(0.5)}, 6) AS median, round({q(0.75)} - {q(0.25)}, 6) AS iqr, round({q(0.25)}, 6) AS q1, round({q(0.75)}, 6) AS q3, round(min({x}), 6) AS lo, round(max({x}), 6) AS hi,
  round(max({x}) - min({x}), 6) AS width, round(CASE WHEN count({x}) = 1 THEN 0.0 ELSE stddev_samp({x}) END, 6) AS sd"""


def _rounded(df, keys):
    return df.select(*keys, "n", *[r6(c).alias(c) for c in ("median", "iqr", "q1", "q3", "lo", "hi", "width", "sd")])


@query(
    "m16_level3",
    f"WITH {PRED_SQL}, kept AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('seed', 'kept')}, long AS (SELECT 'roc_auc' AS metric, roc_auc AS v FROM block UNION ALL SELECT 'fpr_at_recall', fpr_at_recall FROM block) SELECT metric, {_spread_sql('v')} FROM long GROUP BY metric",
)
def m16(spark, d):
    long = R.metric_block(pred(spark, d).where("fold >= 0"), ["seed"]).unpivot("seed", ["roc_auc", "fpr_at_recall"], "metric", "v")
    return _rounded(spread(long, ["metric"], "v"), ["metric"])


@query(
    "m17_pooled_vs_averaged",
    f"""WITH {PRED_SQL}, kept AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('seed', 'kept')}, {_block_sql('seed, fold', 'kept', 'each')}
SELECT b.seed, round(b.roc_auc, 6) AS pooled, round(a.m, 6) AS averaged, round(b.roc_auc - a.m, 6) AS gap FROM block b JOIN (SELECT seed, avg(roc_auc) AS m FROM each GROUP BY seed) a ON a.seed = b.seed""",
)
def m17(spark, d):
    p = pred(spark, d).where("fold >= 0")
    pooled = R.metric_block(p, ["seed"]).select("seed", F.col("roc_auc").alias("pooled"))
    each = R.metric_block(p, ["seed", "fold"]).groupBy("seed").agg(F.avg("roc_auc").alias("averaged"))
    return pooled.join(each, "seed").select("seed", r6("pooled").alias("pooled"), r6("averaged").alias("averaged"), r6(F.col("pooled") - F.col("averaged")).alias("gap"))


@query(
    "m18_holdout_gap",
    f"""WITH {PRED_SQL}, {_block_sql('centre, seed')}, {_block_sql('seed', name='pool')}
SELECT centre, round(quantile_cont(b.fpr_at_recall, 0.5) - (SELECT quantile_cont(fpr_at_recall, 0.5) FROM pool), 6) AS gap, CAST(max(b.n) AS BIGINT) AS n FROM block b GROUP BY centre""",
)
def m18(spark, d):
    p = pred(spark, d)
    own = R.metric_block(p, ["centre", "seed"]).groupBy("centre").agg(F.percentile("fpr_at_recall", F.lit(0.5)).alias("own"), F.max("n").alias("n"))
    pool = R.metric_block(p, ["seed"]).agg(F.percentile("fpr_at_recall", F.lit(0.5)).alias("pool"))
    return own.crossJoin(F.broadcast(pool)).select("centre", r6(F.col("own") - F.col("pool")).alias("gap"), "n")  # one row


_ORDERED = """ranked AS (SELECT seed, score, sum(label_int) OVER (PARTITION BY seed ORDER BY score DESC, filepath ROWS UNBOUNDED PRECEDING) AS tp,
  row_number() OVER (PARTITION BY seed ORDER BY score DESC, filepath) AS n, sum(label_int) OVER (PARTITION BY seed) AS P, sum(1 - label_int) OVER (PARTITION BY seed) AS N_ FROM (SELECT *, logit AS score FROM pred))"""


@query(
    "m19_fpr_ranked",
    f"""WITH {TIES_SQL}, {_ORDERED} SELECT seed, round(min(CASE WHEN tp >= ceil(0.9::DOUBLE * P) THEN (n - tp)::DOUBLE / N_ END), 6) AS fpr,
round(arg_min(tp::DOUBLE / n, n) FILTER (tp >= ceil(0.9::DOUBLE * P)), 6) AS ppv FROM ranked GROUP BY seed""",
)
def m19(spark, d):
    return R.ordered(pred(spark, d, decimals=1), ["seed"]).groupBy("seed").agg(r6(R.fpr_ranked()).alias("fpr"), r6(R.ppv_ranked()).alias("ppv"))


@query("m20_fpr_recall_search", f"WITH {TIES_SQL}, {_ORDERED} SELECT seed, round(min(CASE WHEN tp::DOUBLE / P >= 0.9 THEN (n - tp)::DOUBLE / N_ END), 6) AS fpr FROM ranked GROUP BY seed")
def m20(spark, d):
    return R.ordered(pred(spark, d, decimals=1), ["seed"]).groupBy("seed").agg(r6(R.fpr_recall_search()).alias("fpr"))


@query(
    "m21_per_fold_tail",
    f"WITH {PRED_SQL}, kept AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('seed, fold', 'kept')}, w AS (SELECT seed, max(fpr_at_recall) AS worst FROM block GROUP BY seed) SELECT round(quantile_cont(worst, 0.5), 6) AS median_worst, round(max(worst), 6) AS max_worst FROM w",
)
def m21(spark, d):
    worst = R.metric_block(pred(spark, d).where("fold >= 0"), ["seed", "fold"]).groupBy("seed").agg(F.max("fpr_at_recall").alias("worst"))
    return worst.agg(r6(F.percentile("worst", F.lit(0.5))).alias("median_worst"), r6(F.max("worst")).alias("max_worst"))


@query(
    "m22_restricted_pairs",
    f"""WITH {PRED_SQL}, one AS (SELECT * FROM pred WHERE seed = 0), n AS (SELECT sum(label_int) AS p, sum(1 - label_int) AS q FROM one),
pos AS (SELECT logit FROM one, n WHERE label_int = 1 QUALIFY row_number() OVER (ORDER BY logit, filepath) <= ceil(0.5 * p)),
neg AS (SELECT logit FROM one, n WHERE label_int = 0 QUALIFY row_number() OVER (ORDER BY logit DESC, filepath) <= ceil(0.05::DOUBLE * q))
SELECT round(avg(CASE WHEN a.logit > b.logit THEN 1.0::DOUBLE WHEN a.logit = b.logit THEN 0.5 ELSE 0 END), 6) AS step, round(avg(pow(greatest(1.0 - (a.logit - b.logit), 0), 2)), 6) AS hinge, count(*) AS pairs FROM pos a, neg b""",
)
def m22(spark, d):
    from ..operators.strata import restricted_pairs

    return restricted_pairs(pred(spark, d).where("seed = 0"), max_fpr=0.05, pos_fraction=0.5).select(r6("step").alias("step"), r6("hinge").alias("hinge"), "pairs")


@query(
    "m23_dice_iou",
    """WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS s FROM documents WHERE doc_id < 400),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) AS x, len(b.s) AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT a, b, round(CASE WHEN x + y = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * i / (x + y) END, 6) AS dice, round(CASE WHEN x + y = 0 THEN 1.0::DOUBLE ELSE i::DOUBLE / (x + y - i) END, 6) AS iou FROM p""".replace(" WHERE doc_id < 400", ""),
)
def m23(spark, d):
    from ..operators.diagnostics import dice_iou
    from .bindings import table

    w = table(spark, d, "documents").select("doc_id", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("s"))
    pairs = w.alias("l").join(w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("t")), "doc_id")
    dice, iou = dice_iou(F.col("s"), F.col("t"))
    return pairs.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), r6(dice).alias("dice"), r6(iou).alias("iou"))


@query(
    "m24_counterfactual",
    f"""WITH {PRED_SQL}, x AS (SELECT unnest(['none', 'obvious', 'moderate', 'would_have_missed']) AS excluded), cf AS (SELECT excluded, pred.* FROM pred, x WHERE seed = 0 AND (visibility IS NULL OR visibility <> excluded)), {_block_sql('excluded', 'cf')}
SELECT excluded, round(fpr_at_recall, 6) AS fpr, round(fpr_at_recall - (SELECT fpr_at_recall FROM block WHERE excluded = 'none'), 6) AS delta FROM block""",
)
def m24(spark, d):
    names = F.array(*[F.lit(v) for v in ("none", "obvious", "moderate", "would_have_missed")])
    p = pred(spark, d).where("seed = 0").withColumn("excluded", F.explode(names)).where("visibility is null or visibility <> excluded")
    b = R.metric_block(p, ["excluded"]).select("excluded", "fpr_at_recall")
    base = b.where("excluded = 'none'").select(F.col("fpr_at_recall").alias("base"))
    return b.crossJoin(F.broadcast(base)).select("excluded", r6("fpr_at_recall").alias("fpr"), r6(F.col("fpr_at_recall") - F.col("base")).alias("delta"))  # one row


@query("m25_arm_table", f"WITH {PRED_SQL}, {_block_sql('seed')} SELECT seed, round(roc_auc, 6) AS roc_auc, round(roc_auc - (SELECT roc_auc FROM block WHERE seed = 0), 6) AS delta FROM block")
def m25(spark, d):
    b = R.metric_block(pred(spark, d), ["seed"]).select("seed", "roc_auc")
    base = b.where("seed = 0").select(F.col("roc_auc").alias("base"))
    return b.crossJoin(F.broadcast(base)).select("seed", r6("roc_auc").alias("roc_auc"), r6(F.col("roc_auc") - F.col("base")).alias("delta"))  # one row


# ---- spreads and weighted aggregates


@query("a07_spread", f"WITH {PRED_SQL} SELECT centre, seed, {_spread_sql('logit')} FROM pred GROUP BY centre, seed")
def a07(spark, d):
    return _rounded(spread(pred(spark, d), ["centre", "seed"], "logit"), ["centre", "seed"])


@query("a08_noise_floor", f"WITH {PRED_SQL}, {_block_sql('seed')} SELECT count(*) AS n, round(quantile_cont(roc_auc, 0.5), 6) AS median, round(max(roc_auc) - min(roc_auc), 6) AS mde FROM block")
def a08(spark, d):
    return noise_floor(R.metric_block(pred(spark, d), ["seed"]), [], "roc_auc").select("n", r6("median").alias("median"), r6("mde").alias("mde"))


@query("a09_kish", f"WITH {PRED_SQL}, {_WEIGHTS} SELECT p.seed, round(sum(weight) * sum(weight) / sum(weight * weight), 6) AS kish FROM pred p JOIN w ON p.centre = w.centre WHERE label_int = 0 GROUP BY p.seed")
def a09(spark, d):
    p = pred(spark, d)
    w = prior_weights(p.where("seed = 0"), "centre").select("centre", "weight")
    return p.where("label_int = 0").join(w, "centre").groupBy("seed").agg(r6(kish(F.col("weight"))).alias("kish"))


# ---- ranks


def _ranks(name, operator, sql, out):
    @query(name, f"WITH {TIES_SQL} SELECT filepath, seed, {sql} AS {out} FROM pred")
    def run(spark, d):
        c = operator(pred(spark, d, decimals=1), ["seed"], "logit", out)
        return c.select("filepath", "seed", F.col(out) if out == "rank" else r6(out).alias(out))


_AVG = "(rank() OVER (PARTITION BY seed ORDER BY logit) + (count(*) OVER (PARTITION BY seed, logit) - 1) / 2.0::DOUBLE)"
_ranks("w01_competition_rank", WN.competition_rank, "rank() OVER (PARTITION BY seed ORDER BY logit DESC)", "rank")
_ranks("w02_percent_rank", WN.percent_rank, f"round({_AVG} / count(*) OVER (PARTITION BY seed), 6)", "pct_rank")
_ranks("w03_mid_rank", WN.mid_rank, f"round(({_AVG} - 0.5) / count(*) OVER (PARTITION BY seed), 6)", "rank_norm")
_ranks("w04_average_rank", WN.average_rank, f"round({_AVG}, 6)", "avg_rank")


@query(
    "w05_positive_ranks",
    f"""WITH {PRED_SQL}, r AS (SELECT seed, filepath, row_number() OVER (PARTITION BY seed ORDER BY logit, filepath) AS rank, count(*) OVER (PARTITION BY seed) AS n FROM pred WHERE label_int = 1)
SELECT seed, filepath, rank, round(rank * 100.0::DOUBLE / n, 6) AS percentile, rank <= 16 AS in_bottom16 FROM r""",
)
def w05(spark, d):
    from ..operators.diagnostics import positive_ranks

    return positive_ranks(pred(spark, d), ["seed"]).select("seed", "filepath", "rank", r6("percentile").alias("percentile"), "in_bottom16")


@query("w08_zscore", f"WITH {PRED_SQL} SELECT filepath, seed, round((logit - avg(logit) OVER (PARTITION BY seed)) / stddev_samp(logit) OVER (PARTITION BY seed), 5) AS z FROM pred")
def w08(spark, d):
    return WN.zscore(pred(spark, d), ["seed"], "logit").select("filepath", "seed", F.round("z", 5).alias("z"))


@query("w07_group_centred", f"WITH {PRED_SQL} SELECT p.filepath, p.seed, round(logit - m, 6) AS centred FROM pred p JOIN (SELECT centre, seed, quantile_cont(logit, 0.5) AS m FROM pred GROUP BY centre, seed) g ON p.centre = g.centre AND p.seed = g.seed")
def w07(spark, d):
    return WN.centred(pred(spark, d), ["centre", "seed"], "logit").select("filepath", "seed", r6("centred").alias("centred"))


@query("w09_cumulative_positives", f"WITH {TIES_SQL}, {_ORDERED} SELECT seed, n, CAST(tp AS BIGINT) AS tp FROM ranked")
def w09(spark, d):
    return R.ordered(pred(spark, d, decimals=1), ["seed"]).select("seed", F.col("rows_to").cast("long").alias("n"), F.col("tp").cast("long").alias("tp"))


@query(
    "d10_centre_separability",
    f"""WITH {PRED_SQL}, neg AS (SELECT seed, CASE WHEN p.centre = 'center_2' THEN 1 ELSE 0 END AS y, logit, logit - m AS c FROM pred p JOIN (SELECT centre AS gc, seed AS gs, quantile_cont(logit, 0.5) AS m FROM pred WHERE label_int = 0 GROUP BY 1, 2) g ON p.centre = gc AND p.seed = gs WHERE label_int = 0),
{curve_sql('neg', 'seed', label='y', name='a')}, {curve_sql('neg', 'seed', score='c', label='y', name='b')}
SELECT x.seed, round(x.auc, 6) AS raw, round(y.auc, 6) AS centred FROM (SELECT seed, {M['roc_auc']} AS auc FROM a GROUP BY seed) x JOIN (SELECT seed, {M['roc_auc']} AS auc FROM b GROUP BY seed) y ON x.seed = y.seed""",
)
def d10(spark, d):
    neg = WN.centred(pred(spark, d).where("label_int = 0"), ["centre", "seed"], "logit", "c").withColumn("y", (F.col("centre") == "center_2").cast("int"))
    raw = R.curve(neg, ["seed"], label="y").groupBy("seed").agg(r6(R.auc()).alias("raw"))
    cen = R.curve(neg, ["seed"], label="y", score="c").groupBy("seed").agg(r6(R.auc()).alias("centred"))
    return raw.join(cen, "seed")


@query("p08_finite", f"WITH {PRED_SQL}, x AS (SELECT CASE image_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE WHEN 2 THEN 'Infinity'::DOUBLE ELSE logit END AS v FROM pred) SELECT count(*) FILTER (v IS NOT NULL AND isfinite(v)) AS n_finite, count(*) AS n FROM x")
def p08(spark, d):
    x = pred(spark, d).selectExpr("CASE image_id % 5 WHEN 0 THEN NULL WHEN 1 THEN double('NaN') WHEN 2 THEN double('Infinity') ELSE logit END AS v")
    return x.agg(count_if(finite(F.col("v"))).alias("n_finite"), F.count(F.lit(1)).alias("n"))
