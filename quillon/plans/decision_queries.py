"""Resampling, ensembles, diagnostics, decision rules, bounded-time scoring and kernels.

Projected ends are many-digit sums that often lie on a rounding boundary; a constant moves them off it in both engines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.scalar import r6, sigmoid
from ..operators import diagnostics as D
from ..operators import ensemble as E
from ..operators import ranking as R
from ..operators import relational as L
from ..operators import resample as B
from ..operators import rules as RU
from ..operators import scoring as Y
from ..operators import windows as WN
from ..operators.spread import spread
from .bindings import BATCHES_SQL, PRED_SQL, TIES_SQL, batches, manifest, pred, table
from .metric_queries import _block_sql, _spread_sql
from .registry import query

_H = lambda parts: f"cast('0x' || substr(sha256({parts}), 1, 15) AS BIGINT)"
_U = lambda parts: f"({_H(parts)} / 1152921504606846976.0::DOUBLE)"

# ---- resampling

_DRAWS = f"""one AS (SELECT * FROM pred WHERE seed = 0), t AS (SELECT logit, sum(label_int) AS pos, sum(1 - label_int) AS neg FROM one GROUP BY logit),
c AS (SELECT logit, pos, neg, sum(pos) OVER (ORDER BY logit DESC) AS tp, sum(neg) OVER (ORDER BY logit DESC) AS fp, sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM t),
m AS (SELECT CAST(greatest(1, floor(max(N) / 100)) AS BIGINT) AS m, CAST(max(P) AS BIGINT) AS p FROM c),
k AS (SELECT d AS draw, m, {_H("'0|' || CAST(d AS VARCHAR) || '|' || CAST(i AS VARCHAR)")} % p AS ix FROM (SELECT unnest(range(200)) AS d), (SELECT m, p, unnest(range(1, m + 1)) AS i FROM m)),
s AS (SELECT draw, m, max(N) AS N, fp - neg AS g, fp AS h, count(*) AS x, max(tp) AS o FROM k JOIN c ON pos > 0 AND ix >= tp - pos AND ix < tp GROUP BY draw, m, fp - neg, fp),
z AS (SELECT *, sum(x) OVER (PARTITION BY draw ORDER BY o) AS k1, sum(x) OVER (PARTITION BY draw ORDER BY o) - x AS k0 FROM s),
b AS (SELECT draw, sum(x * (1 - (g + h) / 2.0::DOUBLE / N)) / max(m) AS roc_auc, sum(x::DOUBLE / m * k1 / (k1 + h)) AS ap,
  max(CASE WHEN k0::DOUBLE / m <= 0.9 AND k1::DOUBLE / m > 0.9 THEN (CASE WHEN k0 + g > 0 THEN k0::DOUBLE / (k0 + g) ELSE 1 END) + (0.9::DOUBLE - k0::DOUBLE / m) / (x::DOUBLE / m) * (k1::DOUBLE / (k1 + h) - (CASE WHEN k0 + g > 0 THEN k0::DOUBLE / (k0 + g) ELSE 1 END)) END) AS ppv FROM z GROUP BY draw)"""


@query("b01_prevalence_bootstrap", f"WITH {TIES_SQL}, {_DRAWS} SELECT draw, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS ap, round(ppv, 6) AS ppv FROM b")
def b01(s, d):
    return B.prevalence_bootstrap(pred(s, d, decimals=1).where("seed = 0"), draws=200).select("draw", r6("roc_auc").alias("roc_auc"), r6("ap").alias("ap"), r6("ppv").alias("ppv"))


@query("b01_official_score", f"WITH {TIES_SQL}, {_DRAWS}, l AS (SELECT 'roc_auc' AS metric, roc_auc AS v FROM b UNION ALL SELECT 'ap', ap FROM b UNION ALL SELECT 'ppv', ppv FROM b) SELECT metric, count(v) AS n, round(quantile_cont(v, 0.025), 6) AS lo, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.975), 6) AS hi FROM l GROUP BY metric")
def b01s(s, d):
    draws = B.prevalence_bootstrap(pred(s, d, decimals=1).where("seed = 0"), draws=200)
    return B.summary(draws, ["roc_auc", "ap", "ppv"]).select("metric", "n", r6("lo").alias("lo"), r6("median").alias("median"), r6("hi").alias("hi"))


@query("b01_prevalence_bootstrap_full")
def b01f(s, d):
    """The reference's number of draws."""
    return B.prevalence_bootstrap(pred(s, d, decimals=1).where("seed = 0"), draws=1000).select("draw", r6("roc_auc").alias("roc_auc"), r6("ap").alias("ap"), r6("ppv").alias("ppv"))


@query("b01_official_score_full")
def b01sf(s, d):
    draws = B.prevalence_bootstrap(pred(s, d, decimals=1).where("seed = 0"), draws=1000)
    return B.summary(draws, ["roc_auc", "ap", "ppv"]).select("metric", "n", r6("lo").alias("lo"), r6("median").alias("median"), r6("hi").alias("hi"))


@query("b02_auc_bootstrap")
def b02(s, d):
    return B.summary(B.auc_bootstrap(pred(s, d).where("seed = 0"), draws=2000), ["roc_auc"])


_QUOTA = "n AS (SELECT centre, count(*) AS n FROM manifest GROUP BY centre), q AS (SELECT centre, floor(100 * n / sum(n) OVER ()) AS q, row_number() OVER (ORDER BY centre) AS rn FROM n), quota AS (SELECT centre, CAST(q + CASE WHEN rn <= 100 - (SELECT sum(q) FROM q) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM q)"


@query("b04_stratified_quota", f"WITH {PRED_SQL}, {_QUOTA} SELECT m.filepath, m.centre FROM (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY {_H("'5|' || filepath")}, filepath) AS rn FROM manifest) m JOIN quota ON quota.centre = m.centre WHERE m.rn <= quota.quota")
def b04(s, d):
    m = manifest(s, d)
    return B.stratified_subsample(m, B.proportional_quotas(m, "centre", 100), "centre", "filepath", 5).select("filepath", "centre")


@query("b03_prior_equalised_bootstrap")
def b03p(s, d):
    """The anchor centre's negatives in full, the weight's share of the others', at the recall's threshold."""
    return B.prior_equalised_bootstrap(pred(s, d).where("seed = 0"), "centre", draws=1000, seed=3).select("draw", r6("fpr").alias("fpr"), "n")


_PICK = lambda strata, n: f"""z AS (SELECT {strata}, count(*) AS size, row_number() OVER (ORDER BY {strata}) AS s FROM manifest GROUP BY {strata}),
k AS (SELECT i AS k, {_H("'9|s|' || CAST(i AS VARCHAR)")} % (SELECT count(*) FROM z) + 1 AS s, {_H("'9|r|' || CAST(i AS VARCHAR)")} AS h FROM (SELECT unnest(range({n})) AS i)),
o AS (SELECT {strata}, filepath, row_number() OVER (PARTITION BY {strata} ORDER BY filepath) AS r FROM manifest)"""  # noqa: E731


@query("b06_class_weighted_draw", f"WITH {PRED_SQL}, {_PICK('class_label', 500)} SELECT k.k, o.filepath, o.class_label FROM k JOIN z ON z.s = k.s JOIN o ON o.class_label = z.class_label AND o.r = k.h % z.size + 1")
def b06(s, d):
    return B.weighted_draw(manifest(s, d), 500, ["class_label"], "filepath", 9).select("k", "filepath", "class_label")


@query("b07_balanced_draw", f"WITH {PRED_SQL}, {_PICK('centre, class_label', 500)} SELECT k.k, o.filepath FROM k JOIN z ON z.s = k.s JOIN o ON o.class_label = z.class_label AND o.centre = z.centre AND o.r = k.h % z.size + 1")
def b07(s, d):
    return B.weighted_draw(manifest(s, d), 500, ["centre", "class_label"], "filepath", 9).select("k", "filepath")


@query("b08_realised_strata", f"WITH {PRED_SQL}, {_PICK('centre, class_label', 500)} SELECT z.centre, z.class_label, count(*) AS n FROM k JOIN z ON z.s = k.s GROUP BY 1, 2")
def b08(s, d):
    return B.weighted_draw(manifest(s, d), 500, ["centre", "class_label"], "filepath", 9).groupBy("centre", "class_label").agg(F.count(F.lit(1)).alias("n"))


@query("b09_offset_simulation")
def b09(s, d):
    grid = s.createDataFrame([(2, 0.5), (4, 0.5), (4, 1.0)], "k long, sd double")
    sims = B.offset_simulation(pred(s, d).where("seed = 0"), grid, 1000)
    return sims.groupBy("k", "sd").agg(r6(F.percentile("roc_auc", F.lit(0.5))).alias("median"), r6(F.percentile("roc_auc", F.lit(0.1))).alias("p10"), r6(F.percentile("roc_auc", F.lit(0.9))).alias("p90"))


@query("b11_shift_sweep", f"WITH {PRED_SQL}, sh AS (SELECT CAST(x AS DOUBLE) AS shift, label_int, logit + x * label_int AS v FROM pred, (SELECT unnest([0.0::DOUBLE, 0.5, 1.0]) AS x) WHERE seed = 0), {_block_sql('shift', '(SELECT shift, label_int, v AS logit FROM sh)')} SELECT shift, round(roc_auc, 6) AS roc_auc, round(ap, 6) AS ap FROM block")
def b11(s, d):
    b = R.metric_block(B.shifted(pred(s, d).where("seed = 0"), [0.0, 0.5, 1.0]), ["shift"])
    return b.select("shift", r6("roc_auc").alias("roc_auc"), r6("ap").alias("ap"))


@query("b12_empirical_pmf", "SELECT least(n, 3) AS boxes, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS p FROM (SELECT doc_id, len(regexp_extract_all(text, 'the')) AS n FROM documents) GROUP BY 1")
def b12(s, d):
    n = table(s, d, "documents").select(F.least(F.regexp_count("text", F.lit("the")), F.lit(3)).cast("long").alias("boxes"))
    return L.frequencies(n, "boxes").select("boxes", r6("share").alias("p"))


@query("b14_item_rng", f"SELECT doc_id, {_H("'1|2|' || CAST(doc_id AS VARCHAR)")} AS h, round({_U("'1|2|' || CAST(doc_id AS VARCHAR)")}, 9) AS u FROM documents")
def b14(s, d):
    from ..functions.scalar import draw, uniform

    return table(s, d, "documents").select("doc_id", draw(1, 2, F.col("doc_id")).alias("h"), F.round(uniform(1, 2, F.col("doc_id")), 9).alias("u"))


@query("b15_epoch_seed", "SELECT s AS seed, e AS epoch, CAST((s::HUGEINT * 1000003 + e::HUGEINT * 9176053 + 17) % 9223372036854775807 AS BIGINT) AS value FROM (SELECT unnest(range(5)) AS s), (SELECT unnest(range(30)) AS e)")
def b15(s, d):
    g = s.range(5).withColumnRenamed("id", "seed").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(29).cast("long"))))
    return g.select("seed", "epoch", B.epoch_seed(F.col("seed"), F.col("epoch")).alias("value"))


@query("b16_label_kfold", f"WITH {PRED_SQL} SELECT filepath, CAST((row_number() OVER (PARTITION BY label_int ORDER BY {_H("'4|' || filepath")}, filepath) - 1) % 5 AS BIGINT) AS fold FROM manifest")
def b16(s, d):
    from ..functions.scalar import draw

    m = manifest(s, d).withColumn("h", draw(4, F.col("filepath")))
    return WN.numbered(m, ["label_int"], "h", "filepath").select("filepath", ((F.col("rn") - 1) % 5).cast("long").alias("fold"))


@query("b17_shuffled_cases", f"WITH {PRED_SQL} SELECT filepath, (row_number() OVER (ORDER BY {_H("'8|' || filepath")}, filepath) - 1) % 7 AS case_id FROM manifest")
def b17(s, d):
    return L.permuted(manifest(s, d), 8, "filepath").select("filepath", ((F.col("position") - 1) % 7).alias("case_id"))


# ---- ensembles


@query("e02_mean_ensemble", f"WITH {PRED_SQL} SELECT filepath, round(avg(logit), 6) AS logit FROM pred GROUP BY filepath")
def e02(s, d):
    return E.mean_ensemble(pred(s, d), ["filepath"], "logit", 5).select("filepath", r6("logit").alias("logit"))


@query("e01_wide_table", f"WITH {PRED_SQL} SELECT filepath, {', '.join(f'round(max(logit) FILTER (seed = {k}), 6) AS s{k}' for k in range(5))} FROM pred GROUP BY filepath")
def e01(s, d):
    w = pred(s, d).groupBy("filepath").pivot("seed", [0, 1, 2, 3, 4]).agg(F.first("logit"))
    return w.select("filepath", *[r6(c).alias(f"s{c}") for c in "01234"])


@query(
    "e03_ensemble_curve",
    f"WITH {PRED_SQL}, en AS (SELECT m AS subset, bit_count(m) AS k, filepath, max(label_int) AS label_int, avg(logit) AS logit FROM pred, (SELECT unnest(range(1, 32)) AS m) WHERE (m >> seed) & 1 = 1 GROUP BY 1, 2, 3), {_block_sql('k, subset', 'en')} SELECT CAST(k AS BIGINT) AS k, {_spread_sql('roc_auc')} FROM block GROUP BY k",
)
def e03(s, d):
    en = E.subset_ensembles(pred(s, d), ["filepath", "label_int"], "logit", 5)
    auc = R.curve(en, ["k", "subset"]).groupBy("k", "subset").agg(R.auc().alias("roc_auc"))
    return spread(auc, ["k"], "roc_auc").select("k", "n", *[r6(c).alias(c) for c in ("median", "iqr", "q1", "q3", "lo", "hi", "width", "sd")])


@query("e04_leave_one_out_spread", f"WITH {PRED_SQL}, en AS (SELECT d AS dropped, filepath, max(label_int) AS label_int, avg(logit) AS logit FROM pred, (SELECT unnest(range(5)) AS d) WHERE seed <> d GROUP BY 1, 2), {_block_sql('dropped', 'en')} SELECT {_spread_sql('roc_auc')} FROM block")
def e04(s, d):
    en = L.leave_one_out(pred(s, d), "seed", 5).groupBy("dropped", "filepath", "label_int").agg(F.avg("logit").alias("logit"))
    auc = R.curve(en, ["dropped"]).groupBy("dropped").agg(R.auc().alias("roc_auc"))
    return spread(auc, [], "roc_auc").select("n", *[r6(c).alias(c) for c in ("median", "iqr", "q1", "q3", "lo", "hi", "width", "sd")])


def _fusion(name, how, sql):
    @query(name, f"WITH {PRED_SQL}, {sql} SELECT a.filepath, a.label_int, round((a.f + b.f) / 2, 5) AS fused FROM x a JOIN x b ON a.filepath = b.filepath AND a.seed = 0 AND b.seed = 3")
    def run(s, d):
        p = pred(s, d)
        return E.fuse(p.where("seed = 0"), p.where("seed = 3"), "filepath", how).select("filepath", "label_int", F.round("fused", 5).alias("fused"))


_fusion("e05_logit_fusion", "logit", "x AS (SELECT *, logit AS f FROM pred)")
_fusion("e06_zscore_fusion", "zscore", "x AS (SELECT *, (logit - avg(logit) OVER (PARTITION BY seed)) / stddev_samp(logit) OVER (PARTITION BY seed) AS f FROM pred)")
_fusion("e07_rank_fusion", "rank", "x AS (SELECT *, (rank() OVER (PARTITION BY seed ORDER BY logit) + (count(*) OVER (PARTITION BY seed, logit) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY seed) AS f FROM pred)")


@query("e08_member_scale", f"WITH {PRED_SQL} SELECT seed, round(avg(logit), 6) AS mean, round(stddev_samp(logit), 6) AS sd FROM pred GROUP BY seed")
def e08(s, d):
    return pred(s, d).groupBy("seed").agg(r6(F.avg("logit")).alias("mean"), r6(F.stddev_samp("logit")).alias("sd"))


@query("e10_member_average_sigmoid", f"WITH {PRED_SQL} SELECT filepath, round(1 / (1 + exp(-avg(logit))), 6) AS p FROM pred GROUP BY filepath")
def e10(s, d):
    return pred(s, d).groupBy("filepath").agg(r6(sigmoid(F.avg("logit"))).alias("p"))


@query("e11_view_candidates", f"WITH {PRED_SQL}, v(candidate, view) AS (VALUES ('a', 0), ('a', 1), ('b', 2), ('b', 3), ('b', 4)), en AS (SELECT candidate, filepath, max(label_int) AS label_int, avg(logit) AS logit FROM pred JOIN v ON v.view = pred.seed GROUP BY 1, 2), {_block_sql('candidate', 'en')} SELECT candidate, round(roc_auc, 6) AS roc_auc FROM block")
def e11(s, d):
    views = s.createDataFrame([("a", 0), ("a", 1), ("b", 2), ("b", 3), ("b", 4)], "candidate string, seed long")
    en = pred(s, d).join(F.broadcast(views), "seed").groupBy("candidate", "filepath", "label_int").agg(F.avg("logit").alias("logit"))  # five rows
    return R.metric_block(en, ["candidate"]).select("candidate", r6("roc_auc").alias("roc_auc"))


@query(
    "e12_variance_explained",
    f"""WITH {PRED_SQL}, kept AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('seed', 'kept', 'raw')},
ranked AS (SELECT seed, label_int, (rank() OVER (PARTITION BY seed, fold ORDER BY logit) + (count(*) OVER (PARTITION BY seed, fold, logit) - 1) / 2.0::DOUBLE - 0.5) / count(*) OVER (PARTITION BY seed, fold) AS logit FROM kept),
{_block_sql('seed', 'ranked', 'rk')}
SELECT round(stddev_samp(raw.fpr_at_recall), 6) AS sd_raw, round(stddev_samp(rk.fpr_at_recall), 6) AS sd_rank, round(1 - pow(stddev_samp(rk.fpr_at_recall) / stddev_samp(raw.fpr_at_recall), 2), 6) AS share FROM raw JOIN rk ON raw.seed = rk.seed""",
)
def e12(s, d):
    """The share of the seeds' variance of the false-positive rate that ranking within folds takes away."""
    kept = pred(s, d).where("fold >= 0")
    ranked = WN.mid_rank(kept, ["seed", "fold"], "logit", "rank_norm")
    rate = lambda df, score, name: R.curve(df, ["seed"], score=score).groupBy("seed").agg(R.fpr_interp().alias("fpr")).agg(F.stddev_samp("fpr").alias(name))
    both = rate(kept, "logit", "sd_raw").crossJoin(F.broadcast(rate(ranked, "rank_norm", "sd_rank")))  # one row each
    share = F.when(F.col("sd_raw") > 0, 1 - F.pow(F.col("sd_rank") / F.col("sd_raw"), 2))
    return both.select(r6("sd_raw").alias("sd_raw"), r6("sd_rank").alias("sd_rank"), r6(share).alias("share"))


@query("e13_exponential_average", "WITH v AS (SELECT user_id, list(value ORDER BY event_id) AS xs FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(xs, lambda s, x: 0.9 * s + (1 - 0.9) * x), 6) AS shadow, round(list_avg(xs), 6) AS running FROM v")
def e13(s, d):
    v = table(s, d, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]).alias("xs"))
    mean = F.aggregate("xs", F.lit(0.0), lambda a, x: a + x) / F.size("xs")
    return v.select("user_id", r6(E.exponential_average(F.col("xs"), 0.9)).alias("shadow"), r6(mean).alias("running"))


# ---- diagnostics

_AVG = lambda v, by: f"(rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE)"


@query("d01_spearman", f"WITH {PRED_SQL}, j AS (SELECT seed, logit, file_size FROM pred p JOIN (SELECT filepath AS f, file_size FROM manifest) m ON p.filepath = f), r AS (SELECT seed, {_AVG('logit', 'seed')} AS a, {_AVG('file_size', 'seed')} AS b FROM j) SELECT seed, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY seed")
def d01(s, d):
    j = pred(s, d).join(manifest(s, d).select("filepath", "file_size"), "filepath")
    return D.spearman(j, ["seed"], "logit", "file_size").select("seed", "n", r6("rho").alias("rho"))


@query("d02_kendall", "WITH x AS (SELECT quality AS q, toxic AS t FROM labels), c AS (SELECT q, t, count(*) AS n FROM x GROUP BY 1, 2), s AS (SELECT sum(sign((a.q - b.q) * (a.t - b.t)) * a.n * b.n) AS s FROM c a JOIN c b ON a.q < b.q), w AS (SELECT sum(n) * (sum(n) - 1) / 2 AS p FROM c), tq AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY q)), tt AS (SELECT sum(k * (k - 1) / 2) AS v FROM (SELECT sum(n) AS k FROM c GROUP BY t)) SELECT 'all' AS g, round(s / sqrt((p - tq.v) * (p - tt.v)), 6) AS tau FROM s, w, tq, tt")
def d02(s, d):
    return D.kendall_tau(table(s, d, "labels").withColumn("g", F.lit("all")), ["g"], "quality", "toxic").select("g", r6("tau").alias("tau"))


@query("d03_mann_whitney", f"WITH {PRED_SQL}, x AS (SELECT seed, CASE WHEN centre = 'center_2' THEN 1 ELSE 0 END AS y, {_AVG('logit', 'seed')} AS r FROM pred WHERE label_int = 0), u AS (SELECT seed, sum(y) AS n1, sum(1 - y) AS n2, sum(CASE WHEN y = 1 THEN r END) AS rs FROM x GROUP BY seed) SELECT seed, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(rs - n1 * (n1 + 1) / 2.0, 4) AS u, round((rs - n1 * (n1 + 1) / 2.0) / (n1 * n2), 6) AS auc FROM u")
def d03(s, d):
    neg = pred(s, d).where("label_int = 0").withColumn("y", (F.col("centre") == "center_2").cast("int"))
    return D.mann_whitney(neg, ["seed"], "logit", "y").select("seed", "n1", "n2", F.round("u", 4).alias("u"), r6("auc").alias("auc"))


_CHI = lambda a, b, src, yates: f"t AS (SELECT x.a, y.b, (SELECT count(*) FROM {src} s WHERE s.{a} = x.a AND s.{b} = y.b) AS n FROM (SELECT DISTINCT {a} AS a FROM {src}) x, (SELECT DISTINCT {b} AS b FROM {src}) y), e AS (SELECT n, sum(n) OVER (PARTITION BY a)::DOUBLE * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS e FROM t) SELECT round(sum(pow(abs(n - e) - {yates}, 2) / e), 6) AS chi2, CAST(((SELECT count(DISTINCT a) FROM t) - 1) * ((SELECT count(DISTINCT b) FROM t) - 1) AS BIGINT) AS dof FROM e"


@query("d04_chi_square_yates", f"WITH {_CHI('quality', 'toxic', 'labels', 'least(abs(n - e), 0.5)')}")
def d04(s, d):
    return D.chi_square(table(s, d, "labels"), "quality", "toxic").select(r6("chi2").alias("chi2"), "dof")


@query("d04_chi_square", f"WITH src AS (SELECT lang, toxic FROM documents JOIN labels USING (doc_id)), {_CHI('lang', 'toxic', 'src', '0')}")
def d04b(s, d):
    return D.chi_square(table(s, d, "documents").join(table(s, d, "labels"), "doc_id"), "lang", "toxic").select(r6("chi2").alias("chi2"), "dof")


@query("d05_hypergeometric_tail")
def d05(s, d):
    g = s.createDataFrame([(3, 16, 45, 158), (0, 16, 45, 158), (16, 16, 45, 158), (5, 10, 6, 40)], "k int, drawn int, good int, total int")
    return g.select("k", "drawn", "good", "total", F.round(D.hypergeometric_tail(F.col("k"), F.col("drawn"), F.col("good"), F.col("total")), 9).alias("p"))


@query("d06_visibility_enrichment", f"WITH {PRED_SQL}, r AS (SELECT visibility, row_number() OVER (ORDER BY logit, filepath) AS rn FROM pred WHERE seed = 0 AND label_int = 1) SELECT visibility, count(*) FILTER (rn <= 16) AS observed, round(16.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS expected FROM r GROUP BY visibility")
def d06(s, d):
    from ..functions.scalar import count_if

    r = D.positive_ranks(pred(s, d).where("seed = 0"), ["seed"]).groupBy("visibility").agg(count_if(F.col("in_bottom16")).alias("observed"), F.count(F.lit(1)).alias("n"))
    t = r.agg(F.sum("n").alias("t"))
    return r.crossJoin(F.broadcast(t)).select("visibility", "observed", r6(16.0 * F.col("n") / F.col("t")).alias("expected"))  # one row


@query("d07_positive_rank_summary", f"WITH {PRED_SQL}, r AS (SELECT seed, label_int, rank() OVER (PARTITION BY seed ORDER BY logit DESC) AS rank, count(*) OVER (PARTITION BY seed) AS n FROM pred) SELECT seed, min(rank) AS best, max(rank) AS worst, round(quantile_cont(rank, 0.5), 6) AS median, count(*) FILTER (rank <= 158) AS top, count(*) FILTER (rank > n / 2) AS below FROM r WHERE label_int = 1 GROUP BY seed")
def d07(s, d):
    from ..functions.scalar import count_if

    r = WN.with_ranks(pred(s, d), ["seed"], "logit", descending=True).where("label_int = 1")
    return r.groupBy("seed").agg(F.min("first__").cast("long").alias("best"), F.max("first__").cast("long").alias("worst"), r6(F.percentile("first__", F.lit(0.5))).alias("median"), count_if(F.col("first__") <= 158).alias("top"), count_if(F.col("first__") > F.col("n__") / 2).alias("below"))


@query("d08_hard_negatives", f"WITH {PRED_SQL} SELECT filepath, centre, round(logit, 6) AS logit FROM pred WHERE seed = 0 AND label_int = 0 ORDER BY pred.logit DESC, filepath LIMIT 50")
def d08(s, d):
    return pred(s, d).where("seed = 0 and label_int = 0").orderBy(F.desc("logit"), "filepath").limit(50).select("filepath", "centre", r6("logit").alias("logit"))


_HIST = "s AS (SELECT min(value) AS lo, max(value) AS hi FROM events), h AS (SELECT CAST(least({b} - 1, floor((value - lo) * {b} / (hi - lo))) AS BIGINT) AS bin FROM events, s), g AS (SELECT unnest(range({b})) AS bin), c AS (SELECT g.bin, count(h.bin) AS n FROM g LEFT JOIN h ON h.bin = g.bin GROUP BY g.bin), f AS (SELECT bin, n, lo + (bin + 0.5::DOUBLE) * (hi - lo) / {b} AS centre FROM c, s)"


@query("d13_histogram", f"WITH {_HIST.format(b=30)} SELECT bin, n, round(centre, 6) AS centre FROM f")
def d13(s, d):
    return D.histogram(table(s, d, "events"), [], "value", 30).select("bin", "n", r6("centre").alias("centre"))


@query("d12_otsu", f"WITH {_HIST.format(b=256)}, k AS (SELECT bin, centre, sum(n) OVER (ORDER BY bin) AS w0, sum(n * centre) OVER (ORDER BY bin) AS s0, sum(n) OVER () AS w, sum(n * centre) OVER () AS s FROM f), v AS (SELECT bin, centre, round(CASE WHEN w0 > 0 AND w - w0 > 0 THEN w0::DOUBLE * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) END, 3) AS v FROM k) SELECT 'all' AS g, round(arg_max(centre, (coalesce(v, -1), -bin)), 6) AS threshold FROM v")
def d12(s, d):
    return D.otsu(table(s, d, "events").withColumn("g", F.lit("all")), ["g"], "value").select("g", r6("threshold").alias("threshold"))


@query("d14_resolvable_effects", "SELECT n, rho, round(0.02 / sqrt(n), 9) AS se_mean, round(1.2533 * 0.02 / sqrt(n), 9) AS se_median, round(2 * 0.02 / sqrt(n) * sqrt(2 * (1 - rho)), 9) AS resolvable FROM (SELECT CAST(unnest([3, 5, 10]) AS BIGINT) AS n), (SELECT unnest([0.0::DOUBLE, 0.5]) AS rho)")
def d14(s, d):
    g = s.createDataFrame([(n, r) for n in (3, 5, 10) for r in (0.0, 0.5)], "n long, rho double")
    se = 0.02 / F.sqrt("n")
    return g.select("n", "rho", F.round(se, 9).alias("se_mean"), F.round(1.2533 * se, 9).alias("se_median"), F.round(2 * se * F.sqrt(2 * (1 - F.col("rho"))), 9).alias("resolvable"))


@query("d17_moment_check", "SELECT event_type, round(var_pop(value) / avg(value), 6) AS fano, round(avg(pow(value - m, 3)) / pow(avg(pow(value - m, 2)), 1.5), 5) AS skew FROM events JOIN (SELECT event_type AS t, avg(value) AS m FROM events GROUP BY 1) ON t = event_type GROUP BY event_type")
def d17(s, d):
    return table(s, d, "events").groupBy("event_type").agg(r6(F.var_pop("value") / F.avg("value")).alias("fano"), F.round(F.skewness("value"), 5).alias("skew"))


@query("d19_score_distinctness", f"WITH {PRED_SQL}, q AS (SELECT seed, quantile_cont(logit, 0.1) AS cut FROM pred GROUP BY seed) SELECT p.seed, round(max(cut), 6) AS cut, round(count(DISTINCT logit)::DOUBLE / count(*), 6) AS distinct_share FROM pred p JOIN q ON p.seed = q.seed WHERE logit <= cut GROUP BY p.seed")
def d19(s, d):
    p = WN.with_group(pred(s, d), ["seed"], cut=F.percentile("logit", F.lit(0.1))).where("logit <= cut")
    return p.groupBy("seed").agg(r6(F.max("cut")).alias("cut"), r6(F.countDistinct("logit") / F.count(F.lit(1))).alias("distinct_share"))


@query("d20_score_parity", f"WITH {PRED_SQL}, j AS (SELECT a.centre, a.logit AS x, b.logit AS y FROM pred a JOIN pred b ON a.filepath = b.filepath AND a.seed = 0 AND b.seed = 1), r AS (SELECT *, {_AVG('x', 'centre')} AS rx, {_AVG('y', 'centre')} AS ry FROM j) SELECT centre, round(corr(rx, ry), 6) AS rho, round(avg(abs(x - y)), 6) AS mean_gap, round(max(abs(x - y)), 6) AS max_gap FROM r GROUP BY centre")
def d20(s, d):
    p = pred(s, d)
    j = L.aligned_join(p.where("seed = 0").select("filepath", "centre", "label_int", "logit"), p.where("seed = 1").select("filepath", "label_int", "logit"), ["filepath"], "label_int").withColumnRenamed("logit_a", "x").withColumnRenamed("logit_b", "y")
    j = j.withColumnRenamed("centre_a", "centre")
    gaps = j.groupBy("centre").agg(r6(F.avg(F.abs(F.col("x") - F.col("y")))).alias("mean_gap"), r6(F.max(F.abs(F.col("x") - F.col("y")))).alias("max_gap"))
    return D.spearman(j, ["centre"], "x", "y").select("centre", r6("rho").alias("rho")).join(gaps, "centre")


@query("d21_bit_identity", f"WITH {PRED_SQL}, a AS (SELECT filepath, logit FROM pred WHERE seed = 0), b AS (SELECT filepath, CASE WHEN image_id % 7 = 0 THEN logit + 1e-3 ELSE logit END AS logit FROM pred WHERE seed = 0) SELECT count(*) AS n, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS missing, count(*) FILTER (a.logit <> b.logit) AS n_differ, round(max(abs(a.logit - b.logit)), 9) AS max_gap, 'different' AS status FROM a JOIN b ON a.filepath = b.filepath")
def d21(s, d):
    p = pred(s, d).where("seed = 0")
    other = p.withColumn("logit", F.when(F.col("image_id") % 7 == 0, F.col("logit") + 1e-3).otherwise(F.col("logit")))
    out = D.bit_identity(p, other, ["filepath"], "logit")
    return out.select("n", "extra", "missing", "n_differ", F.round("max_gap", 9).alias("max_gap"), "status")


# ---- decision rules over synthetic arms

_ARMS = """arms AS (SELECT a AS arm, d AS direction, ((a * 7 + d * 3) % 11) / 100.0::DOUBLE AS treatment, ((a * 5 + d) % 11) / 100.0::DOUBLE AS control,
  0.01 + (a % 3) / 100.0::DOUBLE AS iqr_treatment, 0.01 + (a % 2) * 0.02::DOUBLE AS iqr_control, ((a * 7 + d * 3 + a % 3) % 11) / 100.0::DOUBLE AS median_treatment, ((a * 5 + d) % 11) / 100.0::DOUBLE AS median_control
  FROM (SELECT unnest(range(12)) AS a), (SELECT unnest(range(2)) AS d))"""


def _arms(s):
    g = s.range(12).withColumnRenamed("id", "arm").withColumn("direction", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long"))))
    return g.selectExpr(
        "arm", "direction", "((arm * 7 + direction * 3) % 11) / 100.0D AS treatment", "((arm * 5 + direction) % 11) / 100.0D AS control", "0.01D + (arm % 3) / 100.0D AS iqr_treatment", "0.01D + (arm % 2) * 0.02D AS iqr_control",
        "((arm * 7 + direction * 3 + arm % 3) % 11) / 100.0D AS median_treatment", "((arm * 5 + direction) % 11) / 100.0D AS median_control",
    )


@query(
    "r01_component_acceptance",
    f"""WITH {_ARMS}, x AS (SELECT arm, control - treatment AS gain, greatest(iqr_treatment, iqr_control) AS bar, median_control - median_treatment AS shift FROM arms)
SELECT arm, bool_and(gain > 0) AS both_improve, bool_or(gain > bar) AS any_exceeds, bool_and((gain > 0) = (shift > 0)) AS signs_agree, bool_and(gain > 0) AND bool_or(gain > bar) AS accepted FROM x GROUP BY arm""",
)
def r01(s, d):
    return RU.component_acceptance(_arms(s), ["arm"])


@query("r02_outcome_label", f"WITH {_ARMS} SELECT arm, direction, CASE WHEN control - treatment > greatest(iqr_treatment, iqr_control) THEN 'PASS' WHEN control - treatment > 0 THEN 'improved, under IQR' WHEN control - treatment = 0 THEN 'no change' ELSE 'WORSE' END AS outcome FROM arms")
def r02(s, d):
    return _arms(s).select("arm", "direction", RU.outcome_label(F.col("control") - F.col("treatment"), F.col("iqr_treatment"), F.col("iqr_control")).alias("outcome"))


@query("r03_gate_with_veto", f"WITH {_ARMS} SELECT arm, max(control) - max(treatment) > max(iqr_treatment) AND NOT max(treatment - control) > max(iqr_control) AS passed FROM arms GROUP BY arm")
def r03(s, d):
    g = _arms(s).groupBy("arm").agg((F.max("control") - F.max("treatment")).alias("gain"), F.max("iqr_treatment").alias("bar"), F.max(F.col("treatment") - F.col("control")).alias("regress"), F.max("iqr_control").alias("own"))
    return g.select("arm", RU.gate_with_veto(F.col("gain"), F.col("bar"), F.col("regress"), F.col("own")).alias("passed"))


@query("r05_rule_with_missing", f"WITH {_ARMS} SELECT arm, direction, CASE WHEN arm % 4 = 3 THEN NULL ELSE control - treatment > iqr_control AND NOT (direction = 1 AND treatment > 0.08) END AS passed FROM arms")
def r05(s, d):
    missing = F.when(F.col("arm") % 4 == 3, None).otherwise((F.col("direction") == 1) & (F.col("treatment") > 0.08))
    return _arms(s).select("arm", "direction", RU.rule_with_missing(F.col("control") - F.col("treatment"), F.col("iqr_control"), missing).alias("passed"))


@query("r06_resolvability", f"WITH {_ARMS} SELECT arm, direction, round(control - treatment, 6) AS delta, abs(control - treatment) > greatest(iqr_treatment, iqr_control) AS resolvable FROM arms")
def r06(s, d):
    delta = F.col("control") - F.col("treatment")
    return _arms(s).select("arm", "direction", r6(delta).alias("delta"), (F.abs(delta) > F.greatest("iqr_treatment", "iqr_control")).alias("resolvable"))


@query(
    "r08_paired_sign",
    f"""WITH {_ARMS}, q AS (SELECT arm % 3 AS family, CASE WHEN arm % 3 = 2 THEN arm ELSE 0 END AS seed, control - treatment AS delta FROM arms),
g AS (SELECT family, quantile_cont(delta, 0.5) AS median, count(DISTINCT seed) AS seeds, count(*) AS n FROM q GROUP BY family),
c AS (SELECT g.family, median, seeds, n, count(*) FILTER ((delta > 0) = (median > 0)) AS same_sign FROM q JOIN g ON q.family = g.family GROUP BY ALL)
SELECT family, round(median, 6) AS median, same_sign, n, CASE WHEN median > 0 AND same_sign >= 6 THEN 'accept' WHEN median > 0 AND seeds = 1 THEN 'ambiguous' ELSE 'reject' END AS verdict FROM c""",
)
def r08(s, d):
    deltas = _arms(s).select((F.col("arm") % 3).alias("family"), F.when(F.col("arm") % 3 == 2, F.col("arm")).otherwise(0).alias("seed"), (F.col("control") - F.col("treatment")).alias("delta"))
    return RU.paired_sign(deltas, ["family"], 6).select("family", r6("median").alias("median"), "same_sign", "n", "verdict")


@query("r09_deployment_ranking", f"WITH {_ARMS} SELECT arm, row_number() OVER (ORDER BY max(treatment), min(treatment), arm) AS place FROM arms GROUP BY arm")
def r09(s, d):
    g = _arms(s).groupBy("arm").agg(F.max("treatment").alias("worst"), F.min("treatment").alias("tail")).withColumn("one", F.lit(1))
    return WN.numbered(g, ["one"], "worst", "tail", "arm", name="place").select("arm", F.col("place").cast("long").alias("place"))


@query(
    "r10_floor_rule",
    f"""WITH {PRED_SQL}, {_block_sql('seed')}, o AS (SELECT * FROM block WHERE seed = 0)
SELECT b.seed AS arm, round(b.ppv_at_recall - o.ppv_at_recall, 6) AS delta_ppv, round(b.fpr_at_recall - o.fpr_at_recall, 6) AS delta_fpr,
b.ppv_at_recall - o.ppv_at_recall > 0.0518 AND b.fpr_at_recall - o.fpr_at_recall <= 0.0898 AS accepted FROM block b, o WHERE b.seed <> 0""",
)
def r10(s, d):
    arms = R.metric_block(pred(s, d), ["seed"]).select(F.col("seed").alias("arm"), F.col("ppv_at_recall").alias("ppv"), F.col("fpr_at_recall").alias("fpr"))
    return RU.floor_rule(arms, 0).select("arm", r6("delta_ppv").alias("delta_ppv"), r6("delta_fpr").alias("delta_fpr"), "accepted")


@query("r11_rescue_matrix", f"WITH {PRED_SQL}, b AS (SELECT seed, filepath, row_number() OVER (PARTITION BY seed ORDER BY logit, filepath) <= 16 AS low FROM pred WHERE label_int = 1), t AS (SELECT filepath FROM b WHERE seed = 0 AND low) SELECT b.seed, count(*) FILTER (NOT low) AS rescued, count(*) AS targets FROM b JOIN t ON b.filepath = t.filepath GROUP BY b.seed")
def r11(s, d):
    from ..functions.scalar import count_if

    b = D.positive_ranks(pred(s, d), ["seed"])
    t = b.where("seed = 0 and in_bottom16").select("filepath")
    return b.join(t, "filepath").groupBy("seed").agg(count_if(~F.col("in_bottom16")).alias("rescued"), F.count(F.lit(1)).alias("targets"))


@query("r13_nearest_reference", f"WITH {_ARMS} SELECT arm, direction, CASE WHEN abs(treatment - 0.0529) < abs(treatment - 0.028) THEN 'a' WHEN abs(treatment - 0.0529) > abs(treatment - 0.028) THEN 'b' ELSE 'tie' END AS nearest FROM arms")
def r13(s, d):
    return _arms(s).select("arm", "direction", RU.nearest_reference(F.col("treatment"), 0.0529, 0.028).alias("nearest"))


@query("r14_headline", f"WITH {_ARMS}, x AS (SELECT arm % 5 AS family, treatment - control > 0.07 AS r, control - treatment > 0.03 AS i FROM arms) SELECT family, CASE WHEN bool_or(r) THEN 'YES' WHEN bool_or(i) THEN 'NO' ELSE 'INCONCLUSIVE' END AS headline FROM x GROUP BY family")
def r14(s, d):
    x = _arms(s).select((F.col("arm") % 5).alias("family"), (F.col("treatment") - F.col("control") > 0.07).alias("regressed"), (F.col("control") - F.col("treatment") > 0.03).alias("improved"))
    return RU.headline(x, ["family"])


@query("r15_sanity_band", f"WITH {_ARMS} SELECT arm, quantile_cont(treatment, 0.5) BETWEEN 0.02 AND 0.09 AND quantile_cont(treatment, 0.5) < 0.8 * max(control) AS ok FROM arms GROUP BY arm")
def r15(s, d):
    g = _arms(s).groupBy("arm").agg(F.percentile("treatment", F.lit(0.5)).alias("m"), F.max("control").alias("c"))
    return g.select("arm", RU.sanity_band(F.col("m"), 0.02, 0.09, F.col("c")).alias("ok"))


# ---- bounded-time scoring

_RUN = "r AS (SELECT batch, n_items, seconds, sum(n_items) OVER w AS done, sum(seconds) OVER w AS elapsed, sum(n_items) OVER () AS total FROM batches WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING))"


def _with_total(s, d):
    b = batches(s, d).withColumn("run", F.lit(0))
    return WN.with_group(b, ["run"], total=F.sum("n_items"))


@query("y07_progress", f"WITH {BATCHES_SQL}, {_RUN} SELECT batch, CAST(done AS BIGINT) AS done, round(done / elapsed, 6) AS rate, round((total - done) / (done / elapsed), 3) AS eta FROM r")
def y07(s, d):
    return Y.progress(_with_total(s, d), ["run"], F.col("total")).select("batch", F.col("done").cast("long").alias("done"), r6("rate").alias("rate"), F.round("eta", 3).alias("eta"))


@query("y02_projection", f"WITH {BATCHES_SQL}, {_RUN} SELECT batch, round(CASE WHEN row_number() OVER (ORDER BY batch) >= 5 THEN least(elapsed + (total - done) * (sum(seconds) OVER (ORDER BY batch ROWS 1 PRECEDING) / sum(n_items) OVER (ORDER BY batch ROWS 1 PRECEDING)), elapsed + (total - done) * (sum(seconds) OVER (ORDER BY batch ROWS 3 PRECEDING) / sum(n_items) OVER (ORDER BY batch ROWS 3 PRECEDING))) END + 0.00012345::DOUBLE, 3) AS projected FROM r")
def y02(s, d):
    return Y.projection(_with_total(s, d), ["run"], F.col("total")).select("batch", F.round(F.col("projected") + 0.00012345, 3).alias("projected"))


@query("y04_hard_stop", f"WITH {BATCHES_SQL}, {_RUN} SELECT min(batch) AS batch FROM r WHERE elapsed > 480")
def y04(s, d):
    return Y.first_over(batches(s, d).withColumn("run", F.lit(0)), ["run"], 480.0).select("batch")


@query("y05_distinct_fill", "WITH x AS (SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS score FROM events) SELECT event_id, round(coalesce(score, min(score) OVER (PARTITION BY user_id) - 1.0 - (row_number() OVER (PARTITION BY user_id, score IS NULL ORDER BY event_id) - 1) * 1e-6, -10.0 - (row_number() OVER (PARTITION BY user_id, score IS NULL ORDER BY event_id) - 1) * 1e-6), 7) AS score FROM x")
def y05(s, d):
    x = table(s, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("score"))
    return Y.fill_unscored(x, ["user_id"], "event_id", "score").select("event_id", F.round("score", 7).alias("score"))


@query("y06_governor")
def y06(s, d):
    b = batches(s, d).withColumn("run", F.col("batch") % 5)
    g = b.groupBy("run").agg(F.transform(F.array_sort(F.collect_list(F.struct("batch", "seconds"))), lambda x: x["seconds"]).alias("xs"))
    return g.withColumn("g", Y.govern(F.col("xs"), 300.0, 5)).select("run", F.size("xs").alias("total"), r6("g.elapsed").alias("elapsed"), "g.covered", "g.passes", "g.stopped")


@query("y08_run_statistics", f"WITH {BATCHES_SQL} SELECT count(*) AS batches, CAST(sum(n_items) AS BIGINT) AS items, round(sum(seconds), 4) AS seconds, round(max(seconds), 4) AS slowest, count(DISTINCT seconds) AS distinct_times FROM batches")
def y08(s, d):
    return batches(s, d).agg(F.count(F.lit(1)).alias("batches"), F.sum("n_items").alias("items"), F.round(F.sum("seconds"), 4).alias("seconds"), F.round(F.max("seconds"), 4).alias("slowest"), F.countDistinct("seconds").alias("distinct_times"))


@query("y10_review_state", "SELECT user_id, min(event_id) FILTER (event_type <> 'purchase') AS first_unreviewed, count(*) FILTER (event_type = 'purchase') AS reviewed FROM events GROUP BY user_id")
def y10(s, d):
    from ..functions.scalar import count_if

    return table(s, d, "events").groupBy("user_id").agg(F.min(F.when(F.col("event_type") != "purchase", F.col("event_id"))).alias("first_unreviewed"), count_if(F.col("event_type") == "purchase").alias("reviewed"))


# ---- kernels


@query(
    "i04_inner_square",
    """WITH e AS (SELECT event_id, 320.0::DOUBLE + (event_id % 7) / 2.0 AS cx, 240.0::DOUBLE + (event_id % 5) / 4.0 AS cy, CAST(floor((100.0::DOUBLE + event_id % 300) * sqrt(2.0::DOUBLE)) AS BIGINT) AS side FROM events),
q AS (SELECT *, CAST(round_even(cx - side / 2.0::DOUBLE, 0) AS BIGINT) AS l, CAST(round_even(cy - side / 2.0::DOUBLE, 0) AS BIGINT) AS t FROM e)
SELECT event_id, greatest(0, l) AS left_, greatest(0, t) AS top_, least(640, l + side) AS right_, least(480, t + side) AS bottom_ FROM q""",
)
def i04(s, d):
    e = table(s, d, "events").withColumn("r", F.lit(100.0) + F.col("event_id") % 300)
    box = K.inner_square(320.0 + (F.col("event_id") % 7) / 2.0, 240.0 + (F.col("event_id") % 5) / 4.0, F.col("r"), F.lit(640), F.lit(480))
    return e.withColumn("b", box).select("event_id", *[F.col(f"b.{c}").alias(f"{c}_") for c in ("left", "top", "right", "bottom")])


@query(
    "i05_crop_box",
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 6 <> 0 THEN (event_id % 50)::DOUBLE END AS r, (event_id % 100) / 100.0::DOUBLE AS q, 320.0::DOUBLE AS cx, CASE WHEN event_id % 8 = 1 THEN 900.0::DOUBLE ELSE 240.0 END AS cy FROM events),
f AS (SELECT *, CAST(floor(r * sqrt(2.0::DOUBLE)) AS BIGINT) AS side FROM e),
g AS (SELECT *, CAST(round_even(cx - side / 2.0::DOUBLE, 0) AS BIGINT) AS l, CAST(round_even(cy - side / 2.0::DOUBLE, 0) AS BIGINT) AS t FROM f),
h AS (SELECT *, greatest(0, l) AS l2, greatest(0, t) AS t2, least(640, l + side) AS r2, least(480, t + side) AS b2 FROM g),
k AS (SELECT *, CASE WHEN r IS NULL THEN 'no non-black pixels found' WHEN q < 0.904 THEN printf('fit_quality %.4f < floor 0.9040', q) WHEN r2 <= l2 OR b2 <= t2 THEN concat('degenerate inner box (', r2 - l2, 'x', b2 - t2, ')') ELSE '' END AS reason FROM h)
SELECT event_id, reason, reason <> '' AS used_fallback, CASE WHEN r IS NOT NULL THEN q END AS fit_quality, CASE WHEN reason = '' THEN l2 ELSE 140 END AS left_, CASE WHEN reason = '' THEN t2 ELSE 60 END AS top_,
CASE WHEN reason = '' THEN r2 ELSE 500 END AS right_, CASE WHEN reason = '' THEN b2 ELSE 420 END AS bottom_ FROM k""",
)
def i05(s, d):
    r = F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 50).cast("double"))
    c = K.crop_box(r, (F.col("event_id") % 100) / 100.0, F.lit(640), F.lit(480), F.lit(320.0), F.when(F.col("event_id") % 8 == 1, 900.0).otherwise(240.0))
    return table(s, d, "events").withColumn("c", c).select("event_id", "c.reason", "c.used_fallback", "c.fit_quality", *[F.col(f"c.box.{x}").alias(f"{x}_") for x in ("left", "top", "right", "bottom")])


@query(
    "i12_magnitude_scale",
    """SELECT event_id, round(CASE WHEN event_id % 9 = 0 THEN value ELSE 1 + 0.33 * (value - 1) END, 6) AS scaled, CASE WHEN event_id % 9 = 0 THEN value ELSE round_even(100 + 0.33 * (value - 100), 0) END AS whole,
round(CASE WHEN event_id % 9 = 0 THEN value ELSE value / (0.33::DOUBLE * 0.33) END, 6) AS photons FROM events""",
)
def i12(s, d):
    done = F.col("event_id") % 9 == 0
    scaled = lambda one, **k: K.scaled_magnitude(F.col("value"), F.lit(one), 0.33, applied=done, **k)
    return table(s, d, "events").select("event_id", r6(scaled(1.0)).alias("scaled"), scaled(100.0, whole=True).alias("whole"), r6(scaled(0.0, count=True)).alias("photons"))


@query("i14_consensus", "SELECT vec_id, list_transform(range(1, 9), lambda i: (embedding[i] > 0)::INT + (embedding[i + 8] > 0)::INT + (embedding[i + 16] > 0)::INT + (embedding[i + 24] > 0)::INT + (embedding[i + 32] > 0)::INT >= 3) AS mask FROM embeddings")
def i14(s, d):
    votes = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.transform(F.slice("embedding", k * 8 + 1, F.lit(8)), lambda x: (x > 0).cast("int")))
    return table(s, d, "embeddings").select("vec_id", K.consensus(votes).alias("mask"))


@query(
    "i18_schedule",
    """WITH c(total, warmup, w) AS (VALUES (100, 0.1::DOUBLE, 10), (90, 0.05, 4), (37, 0.3, 11), (50, 0.0, 0)), s AS (SELECT *, unnest(range(120)) AS s FROM c)
SELECT total, warmup, s AS step, round(CASE WHEN s < w THEN (s + 1) / w::DOUBLE ELSE 0.5 * (1 + cos(pi() * least(1, greatest(0, (s - w) / (total - w)::DOUBLE)))) END, 6) AS factor FROM s""",
)
def i18(s, d):
    """Warm-ups that round up, down (half to even) and to none; steps beyond the end."""
    runs = [(100, 0.1), (90, 0.05), (37, 0.3), (50, 0.0)]
    parts = [s.range(120).select(F.lit(n).alias("total"), F.lit(w).alias("warmup"), F.col("id").alias("step"), r6(K.warmup_cosine(F.col("id"), n, w)).alias("factor")) for n, w in runs]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


@query("i18_restriction_schedule", "SELECT e AS epoch, round(CASE WHEN e >= 5 THEN 1.0 + least(1, (e - 5) / 4.0::DOUBLE) * (0.15 - 1.0) END, 6) AS beta FROM (SELECT unnest(range(15)) AS e)")
def i18b(s, d):
    return s.range(15).select(F.col("id").alias("epoch"), r6(K.restriction_schedule(F.col("id"))).alias("beta"))


@query("i01_image_features")
def i01(s, d):
    pixels = F.transform("embedding", lambda x: F.least(F.greatest(x * 100 + 60, F.lit(0.0)), F.lit(255.0)))
    return K.image_features(table(s, d, "embeddings").select("vec_id", pixels.alias("pixels")), side=8)
