"""Wider forms of operators: p-values, whole diagnostic bundles, fused ensembles, models, settings and reports."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import tails as T
from ..functions.scalar import count_if, draw, r6
from ..operators import diagnostics as D
from ..operators import ensemble as E
from ..operators import models as MO
from ..operators import ranking as R
from ..operators import relational as L
from ..operators import resample as B
from ..operators import scoring as Y
from ..operators import strata as S
from ..operators import windows as WN
from ..operators.spread import spread
from ..sources import readers, reports, settings, sinks
from ..sources.predictions import temporary_folder
from .bindings import BATCHES_SQL, DUPS_SQL, MANIFEST_SQL, METRICS_SQL, PRED_SQL, batches, curve_sql, dups, manifest, pred, table
from .metric_queries import _block_sql, _spread_sql
from .registry import query

_AVG = lambda v, by="": f"(rank() OVER ({by and f'PARTITION BY {by} '}ORDER BY {v}) + (count(*) OVER (PARTITION BY {by and by + ', '}{v}) - 1) / 2.0::DOUBLE)"
_SPREAD = ("median", "iqr", "q1", "q3", "lo", "hi", "width", "sd")
_H = lambda parts: f"cast('0x' || substr(sha256({parts}), 1, 15) AS BIGINT)"


# ---- diagnostics with subsets and p-values


def _confounds(s, d):
    """Predictions of seed 0 with the manifest's columns, once for each of three subsets."""
    j = pred(s, d).where("seed = 0").join(manifest(s, d).select("filepath", "file_size", F.col("has_redaction").cast("double").alias("has_redaction")), "filepath")
    own = F.when(F.col("label_int") == 1, "positives_only").otherwise("negatives_only")
    return j.withColumn("subset", F.explode(F.array(F.lit("all_rows"), own)))


_CONF = """conf AS (SELECT logit, label_int, file_size::DOUBLE AS file_size, CASE WHEN has_redaction THEN 1.0::DOUBLE ELSE 0 END AS has_redaction, centre FROM (SELECT filepath, logit, label_int FROM pred WHERE seed = 0) p JOIN (SELECT filepath AS f, file_size, has_redaction, centre FROM manifest) m ON f = filepath),
subs AS (SELECT *, unnest(['all_rows', CASE WHEN label_int = 1 THEN 'positives_only' ELSE 'negatives_only' END]) AS subset FROM conf)"""
_RHO = lambda column: f"SELECT '{column}' AS field, subset, count(*) AS n, CASE WHEN count(*) >= 3 AND count(DISTINCT v) >= 2 THEN corr(a, b) END AS rho FROM (SELECT subset, {column} AS v, {_AVG('logit', 'subset')} AS a, {_AVG(column, 'subset')} AS b FROM subs) GROUP BY subset"


def _rhos(s, d):
    c = _confounds(s, d)
    parts = [D.spearman(c, ["subset"], f, "logit").select(F.lit(f).alias("field"), "subset", "n", "rho") for f in ("file_size", "has_redaction")]
    return parts[0].unionByName(parts[1]).withColumn("flagged", F.abs("rho") >= 0.30)


@query("d01_confound_subsets", f"WITH {PRED_SQL}, {_CONF}, r AS ({_RHO('file_size')} UNION ALL {_RHO('has_redaction')}) SELECT field, subset, n, round(rho, 6) AS rho, abs(rho) >= 0.30 AS flagged FROM r")
def d01s(s, d):
    return _rhos(s, d).select("field", "subset", "n", r6("rho").alias("rho"), "flagged")


@query("d01_confound_p_values")
def d01p(s, d):
    """The two-sided p of each rho by Student's t."""
    return _rhos(s, d).select("field", "subset", "n", r6("rho").alias("rho"), T.correlation_tail(F.col("rho"), F.col("n")).alias("p"))


_MW = f"""x AS (SELECT centre = 'center_2' AS y, logit, {_AVG('logit')} AS r, count(*) OVER (PARTITION BY logit) AS t FROM pred WHERE seed = 0 AND label_int = 0),
u AS (SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n2, sum(r) FILTER (y) AS rs, sum(t * t - 1) AS ties, count(*) AS n FROM x)"""


@query("d03_mann_whitney_z", f"WITH {PRED_SQL}, {_MW} SELECT n1, n2, round(rs - n1 * (n1 + 1) / 2.0, 4) AS u, round((rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0 - 0.5 * sign(rs - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0)) / sqrt(n1::DOUBLE * n2 / 12 * (n + 1 - ties / (n::DOUBLE * (n - 1)))), 6) AS z FROM u")
def d03z(s, d):
    return _separability(s, d).select("n1", "n2", F.round("u", 4).alias("u"), r6("z").alias("z"))


def _separability(s, d):
    neg = pred(s, d).where("seed = 0 and label_int = 0").withColumn("y", (F.col("centre") == "center_2").cast("int"))
    return D.mann_whitney_z(neg, [], "logit", "y")


@query("d03_mann_whitney_p")
def d03p(s, d):
    """The two-sided p by the normal distribution, with corrections for ties and continuity."""
    return _separability(s, d).select("n1", "n2", r6("auc").alias("auc"), T.normal_tail(F.col("z")).alias("p"))


@query("d04_fisher_exact")
def d04f(s, d):
    """Chi-square's p (with Yates' correction) and Fisher's exact p of quality against toxicity."""
    labels = table(s, d, "labels")
    cells = labels.agg(*[count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(f"n{q}{t}") for q in (0, 1) for t in (0, 1)])
    chi = D.chi_square(labels, "quality", "toxic")
    both = cells.crossJoin(chi)  # one row each
    return both.select("n00", "n01", "n10", "n11", r6("chi2").alias("chi2"), "dof", T.chi_square_tail(F.col("chi2"), F.col("dof")).alias("chi2_p"), T.fisher_tail(*[F.col(c) for c in ("n00", "n01", "n10", "n11")]).alias("fisher_p"))


_CHOOSE = lambda n, k: f"(lgamma({n} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({n} - {k} + 1.0::DOUBLE))"
_VIS = f"""r AS (SELECT filepath, visibility, label_int, logit, {_AVG('-logit')} / count(*) OVER () AS pct FROM pred WHERE seed = 0),
pos AS (SELECT *, row_number() OVER (ORDER BY logit, filepath) AS rn FROM r WHERE label_int = 1),
sets AS (SELECT 'bottom_16_positives' AS decile, visibility, rn <= 16 AS chosen FROM pos UNION ALL SELECT 'global_bottom_decile', visibility, pct > 0.90 FROM pos),
c AS (SELECT decile, visibility, count(*) FILTER (chosen) AS k, count(*) AS base FROM sets GROUP BY 1, 2), t AS (SELECT decile AS dd, sum(k) AS n, sum(base) AS p FROM c GROUP BY 1)"""


@query(
    "d06_visibility_p_values",
    f"""WITH {PRED_SQL}, {_VIS} SELECT decile, visibility, k AS observed, base, round(n * base / p::DOUBLE, 6) AS expected, round(CASE WHEN n * base > 0 THEN k * p::DOUBLE / (n * base) END, 6) AS enrichment,
round(CASE WHEN n > 0 THEN (SELECT sum(CASE WHEN n - x BETWEEN 0 AND p - base THEN exp({_CHOOSE('base', 'x')} + {_CHOOSE('(p - base)', '(n - x)')} - {_CHOOSE('p', 'n')}) ELSE 0 END) FROM (SELECT unnest(range(k, CAST(least(n, base) AS BIGINT) + 1)) AS x)) END, 6) AS p_value
FROM c JOIN t ON decile = dd""",
)
def d06p(s, d):
    """Both definitions of the lowest decile: the 16 lowest positives, and positives in the lowest tenth of all rows."""
    one = WN.percent_rank(pred(s, d).where("seed = 0"), [], "logit", "pct", descending=True)
    pos = WN.numbered(one.where("label_int = 1"), [], "logit", "filepath")
    sets = pos.select("visibility", F.explode(F.array(F.struct(F.lit("bottom_16_positives").alias("decile"), (F.col("rn") <= 16).alias("chosen")), F.struct(F.lit("global_bottom_decile").alias("decile"), (F.col("pct") > 0.90).alias("chosen")))).alias("x"))
    c = sets.groupBy("x.decile", "visibility").agg(count_if(F.col("x.chosen")).alias("observed"), F.count(F.lit(1)).alias("base"))
    t = c.groupBy("decile").agg(F.sum("observed").alias("n"), F.sum("base").alias("p"))
    j = c.join(t, "decile")
    expected = F.col("n") * F.col("base") / F.col("p")
    tail = D.hypergeometric_tail(*[F.col(x).cast("int") for x in ("observed", "n", "base", "p")])
    return j.select("decile", "visibility", "observed", "base", r6(expected).alias("expected"), r6(F.try_divide(F.col("observed").cast("double"), expected)).alias("enrichment"), r6(F.when(F.col("n") > 0, tail)).alias("p_value"))


def _hard(column: str) -> str:
    return f"SELECT '{column}' AS field, CAST({column} AS VARCHAR) AS value, count(*) FILTER (rn <= 50) AS count_in_top, round(count(*) FILTER (rn <= 50) / sum(count(*) FILTER (rn <= 50)) OVER (), 6) AS share_in_top, round(count(*) / sum(count(*)) OVER (), 6) AS base_rate, round((count(*) FILTER (rn <= 50) / sum(count(*) FILTER (rn <= 50)) OVER ()) / (count(*) / sum(count(*)) OVER ()), 6) AS ratio FROM hn GROUP BY {column}"


_HN = "hn AS (SELECT m.centre, has_redaction, row_number() OVER (ORDER BY logit DESC, p.filepath) AS rn FROM (SELECT * FROM pred WHERE seed = 0 AND label_int = 0) p JOIN manifest m ON m.filepath = p.filepath)"


@query("d08_hard_negative_enrichment", f"WITH {PRED_SQL}, {_HN} {_hard('centre')} UNION ALL {_hard('has_redaction')}")
def d08e(s, d):
    """How often each centre, and redaction, occurs among the 50 highest negatives, against all negatives."""
    neg = pred(s, d).where("seed = 0 and label_int = 0").join(manifest(s, d).select("filepath", "has_redaction"), "filepath")
    parts = []
    for c in ("centre", "has_redaction"):
        e = D.enrichment(neg, [], c, "logit", "filepath", 50)
        t = e.agg(F.sum("all_n").alias("a"), F.sum("top_n").alias("t"))
        parts.append(e.crossJoin(F.broadcast(t)).select(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.col("top_n").alias("count_in_top"), r6(F.col("top_n") / F.col("t")).alias("share_in_top"), r6(F.col("all_n") / F.col("a")).alias("base_rate"), r6("ratio").alias("ratio")))  # one row
    return parts[0].unionByName(parts[1])


@query(
    "d09_diagnostic_bundle",
    f"""WITH {PRED_SQL}, {_CONF}, {_MW}, {_HN}, rho AS ({_RHO('file_size')}), e AS ({_hard('centre')} UNION ALL {_hard('has_redaction')})
SELECT round(1 - (rs - n1 * (n1 + 1) / 2.0) / (n1::DOUBLE * n2), 6) AS centre_auc_negatives, (SELECT round(rho, 6) FROM rho WHERE subset = 'positives_only') AS rho_file_size_positives,
(SELECT round(rho, 6) FROM rho WHERE subset = 'negatives_only') AS rho_file_size_negatives, (SELECT ratio FROM e WHERE field = 'centre' AND value = 'center_2') AS top50_centre2_ratio,
(SELECT ratio FROM e WHERE field = 'has_redaction' AND value = 'true') AS top50_redaction_ratio FROM u""",
)
def d09b(s, d):
    """The five confound figures of one pool."""
    auc = _separability(s, d).select(r6(1 - F.col("auc")).alias("centre_auc_negatives"))
    rho = _rhos(s, d).where("field = 'file_size'").agg(*[r6(F.max(F.when(F.col("subset") == k, F.col("rho")))).alias(f"rho_file_size_{k.split('_')[0]}") for k in ("positives_only", "negatives_only")])
    e = d08e(s, d)
    ratio = e.agg(F.max(F.when(F.col("value") == "center_2", F.col("ratio"))).alias("top50_centre2_ratio"), F.max(F.when((F.col("field") == "has_redaction") & (F.col("value") == "true"), F.col("ratio"))).alias("top50_redaction_ratio"))
    return auc.crossJoin(rho).crossJoin(ratio)  # one row each


@query(
    "d17_noise_equivalence",
    """WITH x AS (SELECT user_id % 4 AS scale, event_type, value, value * (1 + 0.01 * ((event_id * 7919) % 101 - 50) / 50.0::DOUBLE) AS other FROM events),
g AS (SELECT scale, event_type, var_pop(value) AS ref_var, var_pop(other) AS cand_var FROM x GROUP BY 1, 2), r AS (SELECT *, abs(cand_var - ref_var) / greatest(ref_var, 1e-12) AS rel FROM g)
SELECT round(max(rel), 6) AS max_rel_diff_var, arg_max(scale, rel) AS scale, arg_max(event_type, rel) AS event_type, max(rel) <= 0.02 AS passes FROM r""",
)
def d17e(s, d):
    """Whether two noise models have the same variance in every cell within 2 percent, and the worst cell."""
    other = F.col("value") * (1 + 0.01 * ((F.col("event_id") * 7919) % 101 - 50) / 50.0)
    g = table(s, d, "events").withColumn("other", other).groupBy((F.col("user_id") % 4).alias("scale"), "event_type").agg(F.var_pop("value").alias("ref_var"), F.var_pop("other").alias("cand_var"))
    rel = F.abs(F.col("cand_var") - F.col("ref_var")) / F.greatest(F.col("ref_var"), F.lit(1e-12))
    g = g.withColumn("rel", rel)
    return g.agg(r6(F.max("rel")).alias("max_rel_diff_var"), F.max_by("scale", "rel").alias("scale"), F.max_by("event_type", "rel").alias("event_type"), (F.max("rel") <= 0.02).alias("passes"))


@query("d17_power_spectrum")
def d17p(s, d):
    """The mean radial power of each frame's noise field, by distance from the zero frequency."""
    from ..functions import pixels as P
    from .image_queries import frames

    run = lambda img: [(k + 1, float(v)) for k, v in enumerate(P.radial_spectrum(img[8:88, 12:92, 0].astype(float)))]
    return P.map_frames(frames(s, d), ["vec_id"], "distance int, power double", run).groupBy("distance").agg(r6(F.avg("power")).alias("power"))


_GEO = "g AS (SELECT event_type, event_id % 11 = 0 AS failed, event_id % 7 = 0 AS would_fallback, value / (1 + event_id % 7) AS aspect_ratio, (event_id % 100) / 100.0::DOUBLE AS fit_quality FROM events)"


@query(
    "d18_geometry_ranges",
    f"""WITH {_GEO} SELECT event_type, count(*) AS n, count(*) FILTER (failed) AS n_fov_errors, count(*) FILTER (NOT failed AND would_fallback) AS n_would_fallback,
{", ".join(f"round({f} FILTER (NOT failed), 4) AS {c}_{n}" for c in ("aspect_ratio", "fit_quality") for n, f in (("mean", f"avg({c})"), ("median", f"quantile_cont({c}, 0.5)"), ("min", f"min({c})"), ("max", f"max({c})")))} FROM g GROUP BY event_type""",
)
def d18r(s, d):
    e = table(s, d, "events").select("event_type", (F.col("event_id") % 11 == 0).alias("failed"), (F.col("event_id") % 7 == 0).alias("would_fallback"), (F.col("value") / (1 + F.col("event_id") % 7)).alias("aspect_ratio"), ((F.col("event_id") % 100) / 100.0).alias("fit_quality"))
    good = lambda c: F.when(~F.col("failed"), F.col(c))
    stats = [F.round(f(good(c)), 4).alias(f"{c}_{n}") for c in ("aspect_ratio", "fit_quality") for n, f in (("mean", F.avg), ("median", lambda v: F.percentile(v, F.lit(0.5))), ("min", F.min), ("max", F.max))]
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), count_if(F.col("failed")).alias("n_fov_errors"), count_if(~F.col("failed") & F.col("would_fallback")).alias("n_would_fallback"), *stats)


_SERVED = "p AS (SELECT seed, 1 / (1 + exp(-4 * logit)) AS p FROM pred), q AS (SELECT seed, quantile_cont(p, 0.1) AS cut FROM p GROUP BY seed)"


@query(
    "d19_served_scores",
    f"""WITH {PRED_SQL}, {_SERVED} SELECT p.seed, count(*) AS n, count(DISTINCT p) AS n_distinct, round(100.0 * count(DISTINCT p) / count(*), 3) AS pct_distinct, count(*) FILTER (p < 1e-4) AS below_1e4, count(*) FILTER (p < 1e-6) AS below_1e6,
count(*) FILTER (p < 1e-8) AS below_1e8, count(*) FILTER (p <= cut) AS n_bottom, count(DISTINCT CASE WHEN p <= cut THEN p END) AS distinct_bottom FROM p JOIN q ON p.seed = q.seed GROUP BY p.seed""",
)
def d19s(s, d):
    from ..functions.scalar import sigmoid

    p = WN.with_group(pred(s, d).select("seed", sigmoid(4 * F.col("logit")).alias("p")), ["seed"], cut=F.percentile("p", F.lit(0.1)))
    below = [count_if(F.col("p") < t).alias(n) for t, n in ((1e-4, "below_1e4"), (1e-6, "below_1e6"), (1e-8, "below_1e8"))]
    n, distinct = F.count(F.lit(1)), F.countDistinct("p")
    return p.groupBy("seed").agg(n.alias("n"), distinct.alias("n_distinct"), F.round(100.0 * distinct / n, 3).alias("pct_distinct"), *below, count_if(F.col("p") <= F.col("cut")).alias("n_bottom"), F.countDistinct(F.when(F.col("p") <= F.col("cut"), F.col("p"))).alias("distinct_bottom"))


_PAR = """j AS (SELECT a.filepath, a.label_int, CASE WHEN a.fold = 0 THEN 'own_fold' ELSE 'other_folds' END AS part, a.logit AS x, b.logit + 0.0001 * (a.image_id % 7) AS y FROM pred a JOIN pred b ON a.filepath = b.filepath AND a.seed = 0 AND b.seed = 0),
k AS (SELECT *, unnest(['all', part]) AS grp FROM j)"""


@query(
    "d20_parity_gate",
    f"""WITH {PRED_SQL}, {_PAR}, {curve_sql('k', 'grp', score='x', name='cx')}, {curve_sql('k', 'grp', score='y', name='cy')},
ax AS (SELECT grp, {METRICS_SQL['roc_auc']} AS auc, {METRICS_SQL['fpr_at_recall']} AS fpr FROM cx GROUP BY grp), ay AS (SELECT grp, {METRICS_SQL['roc_auc']} AS auc FROM cy GROUP BY grp),
r AS (SELECT grp, corr(rx, ry) AS rho, avg(abs(x - y)) AS mean_gap, max(abs(x - y)) AS max_gap, count(*) AS n FROM (SELECT *, {_AVG('x', 'grp')} AS rx, {_AVG('y', 'grp')} AS ry FROM k) GROUP BY grp)
SELECT r.grp, n, round(ax.auc, 6) AS auc, round(ay.auc, 6) AS reference_auc, round(fpr, 6) AS fpr, round(rho, 6) AS rho, round(mean_gap, 6) AS mean_gap, round(max_gap, 6) AS max_gap,
max_gap <= 0.05 AND rho >= 0.999 AND abs(ax.auc - ay.auc) <= 1e-3 AS passes FROM r JOIN ax ON ax.grp = r.grp JOIN ay ON ay.grp = r.grp""",
)
def d20g(s, d):
    """Two services' scores of the same rows, in all and by part: gaps, rank correlation, both AUROCs, and the gate."""
    k = _parity(s, d).withColumn("grp", F.explode(F.array(F.lit("all"), "part")))
    auc = lambda c, n: R.curve(k, ["grp"], score=c).groupBy("grp").agg(R.auc().alias(n), R.fpr_interp().alias(f"fpr_{n}"))
    gaps = k.groupBy("grp").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mean_gap"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_gap"))
    j = D.spearman(k, ["grp"], "x", "y").join(gaps, "grp").join(auc("x", "auc"), "grp").join(auc("y", "reference_auc"), "grp")
    passes = (F.col("max_gap") <= 0.05) & (F.col("rho") >= 0.999) & (F.abs(F.col("auc") - F.col("reference_auc")) <= 1e-3)
    return j.select("grp", "n", r6("auc").alias("auc"), r6("reference_auc").alias("reference_auc"), r6("fpr_auc").alias("fpr"), r6("rho").alias("rho"), r6("mean_gap").alias("mean_gap"), r6("max_gap").alias("max_gap"), passes.alias("passes"))


def _parity(s, d):
    p = pred(s, d).where("seed = 0")
    part = F.when(F.col("fold") == 0, "own_fold").otherwise("other_folds")
    return p.select("filepath", "label_int", part.alias("part"), F.col("logit").alias("x"), (F.col("logit") + 0.0001 * (F.col("image_id") % 7)).alias("y"))


@query("d20_worst_ranks", f"WITH {PRED_SQL}, {_PAR}, r AS (SELECT filepath, abs({_AVG('x')} - {_AVG('y')}) AS gap FROM j) SELECT filepath, gap FROM r ORDER BY gap DESC, filepath LIMIT 20")
def d20w(s, d):
    """The 20 rows whose ranks disagree most."""
    ranked = WN.average_rank(WN.average_rank(_parity(s, d), [], "x", "rx"), [], "y", "ry")
    return ranked.select("filepath", F.abs(F.col("rx") - F.col("ry")).alias("gap")).orderBy(F.desc("gap"), "filepath").limit(20)


# ---- metrics


@query(
    "m10_operating_bracket",
    f"""WITH {PRED_SQL}, {curve_sql('pred', 'centre, seed')}, g AS (SELECT centre, seed, max(P) AS p, max(N) AS n, CAST(floor(0.9::DOUBLE * max(P)) AS BIGINT) AS lo, CAST(ceil(0.9::DOUBLE * max(P)) AS BIGINT) AS hi FROM curve GROUP BY 1, 2),
a AS (SELECT c.centre, c.seed, max(lo) AS lo, max(hi) AS hi, max(g.n) AS n, min(fp) FILTER (tp >= lo) AS fp_lo, min(fp) FILTER (tp >= hi) AS fp_hi FROM curve c JOIN g ON c.centre = g.centre AND c.seed = g.seed GROUP BY 1, 2)
SELECT centre, seed, lo AS tp_lo, hi AS tp_hi, CAST(fp_lo AS BIGINT) AS fp_lo, CAST(fp_hi AS BIGINT) AS fp_hi, round((fp_hi - fp_lo) / n::DOUBLE, 6) AS width FROM a""",
)
def m10b(s, d):
    """The two attainable points around the target recall: true and false positives, and the distance of their rates."""
    parts = R.operating_point()
    c = R.curve(pred(s, d), ["centre", "seed"])
    g = c.groupBy("centre", "seed").agg(*[v.alias(k) for k, v in parts.items()], F.max("N").alias("n"))
    fp = lambda k: F.round(F.col(f"fpr_{k}") * F.col("n")).cast("long")
    return g.select("centre", "seed", F.col("tp_floor").alias("tp_lo"), F.col("tp_ceil").alias("tp_hi"), fp("floor").alias("fp_lo"), fp("ceil").alias("fp_hi"), r6(F.abs(F.col("fpr_ceil") - F.col("fpr_floor"))).alias("width"))


_LOCO = f"""loco AS (SELECT p.seed, p.centre AS held_out, p.label_int, p.filepath, p.logit - 0.3 * (p.image_id % 5) AS logit FROM pred p JOIN manifest m ON m.filepath = p.filepath WHERE m.keep_for_training),
{_block_sql('held_out, seed', 'loco', 'lb')}, oof AS (SELECT * FROM pred WHERE fold >= 0), {_block_sql('seed', 'oof', 'pb')},
tr AS (SELECT h AS held_out, count(*) AS n_train, CAST(sum(label_int) AS BIGINT) AS n_train_pos FROM manifest, (SELECT unnest(['center_1', 'center_2']) AS h) WHERE centre <> h AND fold_r0 <> -1 GROUP BY h)"""


@query(
    "m18_domain_gap",
    f"""WITH {PRED_SQL}, {_LOCO} SELECT lb.held_out, max(n_train) AS n_train, max(n_train_pos) AS n_train_pos, max(n) AS n_test, max(n_pos) AS n_test_pos, round(quantile_cont(fpr_at_recall, 0.5), 6) AS loco_fpr, round(quantile_cont(fpr_at_recall, 0.75) - quantile_cont(fpr_at_recall, 0.25), 6) AS loco_iqr,
round(quantile_cont(fpr_at_recall, 0.5) - (SELECT quantile_cont(fpr_at_recall, 0.5) FROM pb), 6) AS gap FROM lb JOIN tr ON tr.held_out = lb.held_out GROUP BY lb.held_out""",
)
def m18g(s, d):
    """Runs that held a centre out (duplicates left out of the test), by direction and never averaged: training and test
    counts from the manifest, the median rate over seeds, and its distance from the pooled out-of-fold median."""
    m = manifest(s, d)
    loco = pred(s, d).join(m.where("keep_for_training").select("filepath"), "filepath", "left_semi").withColumn("logit", F.col("logit") - 0.3 * (F.col("image_id") % 5)).withColumnRenamed("centre", "held_out")
    by_seed = R.metric_block(loco, ["held_out", "seed"])
    test = by_seed.groupBy("held_out").agg(F.max("n").alias("n_test"), F.max("n_pos").alias("n_test_pos"))
    rate = spread(by_seed, ["held_out"], "fpr_at_recall").select("held_out", F.col("median").alias("loco"), "iqr")
    pooled = spread(R.metric_block(pred(s, d).where("fold >= 0"), ["seed"]), [], "fpr_at_recall").select(F.col("median").alias("pooled"))
    train = m.where("fold_r0 <> -1").withColumn("held_out", F.when(F.col("centre") == "center_1", "center_2").otherwise("center_1")).groupBy("held_out").agg(F.count(F.lit(1)).alias("n_train"), F.sum("label_int").alias("n_train_pos"))
    j = train.join(test, "held_out").join(rate, "held_out").crossJoin(F.broadcast(pooled))  # one row
    return j.select("held_out", "n_train", "n_train_pos", "n_test", "n_test_pos", r6("loco").alias("loco_fpr"), r6("iqr").alias("loco_iqr"), r6(F.col("loco") - F.col("pooled")).alias("gap"))


_M25 = "o AS (SELECT * FROM block WHERE seed = 0)"


@query("m25_arm_metrics", f"WITH {PRED_SQL}, {_block_sql('seed')}, {_M25} SELECT b.seed AS arm, {', '.join(f'round(b.{c}, 6) AS {c}, round(b.{c} - o.{c}, 6) AS delta_{c}' for c in ('roc_auc', 'fpr_at_recall', 'ppv_at_recall'))} FROM block b, o")
def m25(s, d):
    """Each arm's AUROC, false-positive rate and precision, and their differences from the control."""
    names = ("roc_auc", "fpr_at_recall", "ppv_at_recall")
    b = R.metric_block(pred(s, d), ["seed"]).select("seed", *names)
    o = b.where("seed = 0").select(*[F.col(c).alias(f"o_{c}") for c in names])
    return b.crossJoin(F.broadcast(o)).select(F.col("seed").alias("arm"), *[x for c in names for x in (r6(c).alias(c), r6(F.col(c) - F.col(f"o_{c}")).alias(f"delta_{c}"))])  # one row


@query("m25_pooled_gate")
def m25g(s, d):
    """The prevalence-matched bootstrap (1000 draws) of each arm's pooled scores: medians, and the gate against the control."""
    p = pred(s, d).where(F.col("seed") < 3)
    draws = B.prevalence_bootstrap(p, draws=1000, by=["seed"], seed=20260821).groupBy(F.col("seed").cast("int").alias("arm"))
    out = s.range(3).select(F.col("id").cast("int").alias("arm")).join(draws.agg(F.avg("roc_auc").alias("pooled_auroc"), F.percentile("ppv", F.lit(0.5)).alias("pooled_ppv")), "arm", "left")
    base = out.where("arm = 0").select(F.col("pooled_ppv").alias("control"))
    j = out.crossJoin(F.broadcast(base))  # one row
    return j.select("arm", r6("pooled_auroc").alias("pooled_auroc"), r6("pooled_ppv").alias("pooled_ppv"), r6(F.col("pooled_ppv") - F.col("control")).alias("delta_ppv"), (F.col("pooled_ppv") - F.col("control") > 0.0518).alias("above_floor"))


# ---- ensembles

_RANKED = f"rk AS (SELECT filepath, label_int, seed, fold, logit, ({_AVG('logit', 'seed, fold')} - 0.5) / count(*) OVER (PARTITION BY seed, fold) AS rank_norm FROM pred WHERE fold >= 0)"
_SUBSETS = "WHERE (m >> seed) & 1 = 1 GROUP BY 1, 2, 3"


@query(
    "e03_rank_fusion_curve",
    f"""WITH {PRED_SQL}, {_RANKED}, en AS (SELECT m AS subset, bit_count(m) AS k, filepath, max(label_int) AS label_int, round(avg(rank_norm), 9) AS logit FROM rk, (SELECT unnest(range(1, 32)) AS m) {_SUBSETS}), {_block_sql('k, subset', 'en')}
SELECT CAST(k AS BIGINT) AS k, {_spread_sql('fpr_at_recall')} FROM block GROUP BY k""",
)
def e03r(s, d):
    """The spread of the false-positive rate over all subsets of k members, fused by the mean of ranks within folds."""
    ranked = WN.mid_rank(pred(s, d).where("fold >= 0"), ["seed", "fold"], "logit", "rank_norm")
    en = E.subset_ensembles(ranked, ["filepath", "label_int"], "rank_norm", 5).withColumn("rank_norm", F.round("rank_norm", 9))
    fpr = R.curve(en, ["k", "subset"], score="rank_norm").groupBy("k", "subset").agg(R.fpr_interp().alias("fpr"))
    return spread(fpr, ["k"], "fpr").select(F.col("k").cast("long").alias("k"), "n", *[r6(c).alias(c) for c in _SPREAD])


_REPEATS = "rp AS (SELECT r AS repeat, filepath, seed, max(label_int) AS label_int, avg(logit - 0.2 * ((image_id + r * 13 + seed) % 3)) AS logit FROM pred, (SELECT unnest(range(3)) AS r) WHERE fold >= 0 GROUP BY 1, 2, 3), en AS (SELECT repeat, filepath, max(label_int) AS label_int, avg(logit) AS logit FROM rp GROUP BY 1, 2)"


@query(
    "e09_cross_repeat_gate",
    f"""WITH {PRED_SQL}, {_REPEATS}, {_block_sql('repeat', 'en', 'each')}, {_block_sql('', 'en', 'whole')}
SELECT round((SELECT roc_auc FROM whole), 6) AS pooled_auc, round((SELECT fpr_at_recall FROM whole), 6) AS pooled_fpr, count(*) AS repeats, round(quantile_cont(fpr_at_recall, 0.5), 6) AS median_fpr, round(quantile_cont(fpr_at_recall, 0.75) - quantile_cont(fpr_at_recall, 0.25), 6) AS bar FROM each""",
)
def e09g(s, d):
    """Ensembles of three repeats: metrics of their concatenation, and the spread across repeats as the bar."""
    p = pred(s, d).where("fold >= 0").withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    p = p.withColumn("logit", F.col("logit") - 0.2 * ((F.col("image_id") + F.col("repeat") * 13 + F.col("seed")) % 3))
    en = E.mean_ensemble(p, ["repeat", "filepath", "label_int"], "logit", 5)
    each, whole = R.metric_block(en, ["repeat"]), R.metric_block(en, [])
    bar = spread(each, [], "fpr_at_recall").select(F.col("n").alias("repeats"), "median", "iqr")
    return whole.crossJoin(bar).select(r6("roc_auc").alias("pooled_auc"), r6("fpr_at_recall").alias("pooled_fpr"), "repeats", r6("median").alias("median_fpr"), r6("iqr").alias("bar"))  # one row each


#: Which of the eleven views each candidate averages.
CANDIDATES = {"identity": [0], "hflip": [0, 1], "flips": [0, 1, 2, 3], "turns": [0, 1, 2, 3, 4, 5], "crops": [0, 6, 7, 8, 9, 10]}
_VIEWS = ", ".join(f"('{n}', {v})" for n, vs in CANDIDATES.items() for v in vs)


@query(
    "e11_view_wins",
    f"""WITH {PRED_SQL}, c(candidate, view) AS (VALUES {_VIEWS}), v AS (SELECT centre, seed * 2 + h AS run, filepath, label_int, view, logit + 0.4 * (((image_id + view * 17 + seed * 5 + h * 3) % 23) / 23.0::DOUBLE - 0.5) AS logit FROM pred, (SELECT unnest(range(11)) AS view), (SELECT unnest(range(2)) AS h)),
en AS (SELECT candidate, centre, run, filepath, max(label_int) AS label_int, avg(logit) AS logit FROM v JOIN c ON c.view = v.view GROUP BY 1, 2, 3, 4), {_block_sql('candidate, centre, run', 'en')},
w AS (SELECT b.candidate, b.centre, count(*) FILTER (round(b.fpr_at_recall, 9) < round(i.fpr_at_recall, 9)) AS wins FROM block b JOIN block i ON i.candidate = 'identity' AND i.centre = b.centre AND i.run = b.run WHERE b.candidate <> 'identity' GROUP BY 1, 2)
SELECT candidate, max(wins) FILTER (centre = 'center_1') AS wins_c1, max(wins) FILTER (centre = 'center_2') AS wins_c2, CASE WHEN min(wins) >= 8 THEN 'ACCEPT' WHEN max(wins) >= 8 THEN 'REJECT (mixed)' ELSE 'REJECT' END AS verdict FROM w GROUP BY candidate""",
)
def e11w(s, d):
    """Eleven views a row and run; each candidate is the mean of some. A candidate is taken if it has a lower
    false-positive rate than the plain view in 8 of 10 runs in both directions."""
    views = s.createDataFrame([(n, v) for n, vs in CANDIDATES.items() for v in vs], "candidate string, view long")
    seq = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    v = pred(s, d).withColumn("view", F.explode(seq(11))).withColumn("h", F.explode(seq(2)))
    v = v.select("centre", (F.col("seed") * 2 + F.col("h")).alias("run"), "filepath", "label_int", "view", (F.col("logit") + 0.4 * (((F.col("image_id") + F.col("view") * 17 + F.col("seed") * 5 + F.col("h") * 3) % 23) / 23.0 - 0.5)).alias("logit"))
    # A row's views meet in one row; the candidates' means are taken there.
    wide = v.groupBy("centre", "run", "filepath", "label_int").agg(*[F.max(F.when(F.col("view") == k, F.col("logit"))).alias(f"v{k}") for k in range(11)])
    means = F.array(*[F.struct(F.lit(n).alias("candidate"), (sum((F.col(f"v{k}") for k in vs[1:]), F.col(f"v{vs[0]}")) / len(vs)).alias("logit")) for n, vs in CANDIDATES.items()])
    en = wide.select("centre", "run", "filepath", "label_int", F.explode(means).alias("x")).select("x.candidate", "centre", "run", "filepath", "label_int", "x.logit")
    fpr = R.curve(en, ["candidate", "centre", "run"]).groupBy("candidate", "centre", "run").agg(F.round(R.fpr_interp(), 9).alias("fpr"))
    plain = fpr.where("candidate = 'identity'").select("centre", "run", F.col("fpr").alias("plain"))
    wins = fpr.where("candidate <> 'identity'").join(plain, ["centre", "run"]).groupBy("candidate", "centre").agg(count_if(F.col("fpr") < F.col("plain")).alias("wins"))
    verdict = F.when(F.min("wins") >= 8, "ACCEPT").when(F.max("wins") >= 8, "REJECT (mixed)").otherwise("REJECT")
    return wins.groupBy("candidate").agg(*[F.max(F.when(F.col("centre") == f"center_{k}", F.col("wins"))).alias(f"wins_c{k}") for k in (1, 2)], verdict.alias("verdict"))


@query("e13_decayed_average", "WITH v AS (SELECT user_id, list(value ORDER BY event_id) AS xs FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(xs, lambda s, x: 0.9 * s + (1 - 0.9) * x), 6) AS shadow, round(list_avg(xs), 6) AS running FROM v")
def e13d(s, d):
    """The exponential average in closed form over row numbers: no array of a user's values is built."""
    v = WN.with_group(WN.numbered(table(s, d, "events"), ["user_id"], "event_id"), ["user_id"], n=F.count(F.lit(1)))
    weight = F.when(F.col("rn") == 1, 1.0).otherwise(1 - 0.9) * F.pow(F.lit(0.9), F.col("n") - F.col("rn"))
    return v.groupBy("user_id").agg(r6(F.sum(F.col("value") * weight)).alias("shadow"), r6(F.avg("value")).alias("running"))


# ---- resampling

_QUOTA4 = f"""c AS (SELECT centre, label_int, count(*) AS n FROM manifest GROUP BY 1, 2), sh AS (SELECT *, n / sum(n) OVER (PARTITION BY label_int)::DOUBLE AS share, row_number() OVER (PARTITION BY label_int ORDER BY centre DESC) = 1 AS last FROM c),
pq AS (SELECT centre, CASE WHEN last THEN 30 - (SELECT sum(greatest(1, round_even(30 * share, 0))) FROM sh x WHERE x.label_int = 1 AND NOT x.last) ELSE greatest(1, round_even(30 * share, 0)) END AS quota, n FROM sh WHERE label_int = 1),
np AS (SELECT sum(least(quota, n)) AS got FROM pq),
nq AS (SELECT centre, CASE WHEN last THEN 200 - got - (SELECT sum(greatest(1, round_even((200 - got) * x.share, 0))) FROM sh x WHERE x.label_int = 0 AND NOT x.last) ELSE greatest(1, round_even((200 - got) * share, 0)) END AS quota, n FROM sh, np WHERE label_int = 0),
q AS (SELECT centre, 1 AS label_int, quota FROM pq UNION ALL SELECT centre, 0, quota FROM nq),
o AS (SELECT m.filepath, m.centre, m.label_int, row_number() OVER (PARTITION BY m.centre, m.label_int ORDER BY {_H("'80|' || m.filepath")}, m.filepath) AS rn, quota FROM manifest m JOIN q ON q.centre = m.centre AND q.label_int = m.label_int),
f AS (SELECT *, rn <= quota AS first, row_number() OVER (ORDER BY rn > quota, {_H("'80|' || filepath")}, filepath) AS place FROM o)"""


@query("b04_probe_selection", f"WITH {PRED_SQL}, {_QUOTA4} SELECT filepath, centre, label_int FROM f WHERE place <= 200")
def b04p(s, d):
    """200 rows with a floor of 30 positives split by the centres' shares, negatives by theirs; topped up or trimmed to 200."""
    return B.probe_selection(manifest(s, d), 200, 30, seed=80).select("filepath", "centre", "label_int")


@query("b10_bisection")
def b10b(s, d):
    """The sd at which the simulated median AUROC falls to a target: doubled until it is reached, then bisected to 0.005."""
    p = pred(s, d).where("seed = 0")
    rows = []
    for k, target in ((3, 0.80), (5, 0.80)):
        found = B.sd_for_target(p, k, target, draws=400)
        rows.append((k, target, *found))
    return s.createDataFrame(rows, "k int, target double, sd double, sd_hi_tested double, median_at_hi double, steps int")


_SPREADS = "nm AS (SELECT avg(logit) AS mu FROM pred WHERE seed = 0 AND label_int = 0), sw AS (SELECT x AS m, label_int, CASE WHEN label_int = 0 THEN mu + x * (logit - mu) ELSE logit END AS logit FROM pred, nm, (SELECT unnest([0.5::DOUBLE, 1.0, 1.5, 2.0]) AS x) WHERE seed = 0)"


@query("b11_negative_spread", f"WITH {PRED_SQL}, {_SPREADS}, {_block_sql('m', 'sw')} SELECT m, round(roc_auc, 6) AS roc_auc, round(ppv_at_recall, 6) AS ppv_at_recall FROM block")
def b11n(s, d):
    """Negatives spread about their mean by a factor: the metrics at each."""
    return R.metric_block(B.spread_negatives(pred(s, d).where("seed = 0"), [0.5, 1.0, 1.5, 2.0]), ["m"]).select("m", r6("roc_auc").alias("roc_auc"), r6("ppv_at_recall").alias("ppv_at_recall"))


@query("b11_official_sweep")
def b11o(s, d):
    """The prevalence-matched score (1000 draws) with the positives moved down by 0, 0.5 and 1."""
    moved = B.shifted(pred(s, d).where("seed = 0"), [0.0, -0.5, -1.0])
    draws = B.prevalence_bootstrap(moved, draws=1000, by=["shift"], seed=20260821).groupBy(F.abs("shift").alias("shift"))
    shifts = s.createDataFrame([(0.0,), (0.5,), (1.0,)], "shift double")
    return shifts.join(draws.agg(r6(F.avg("roc_auc")).alias("auroc"), r6(F.percentile("ppv", F.lit(0.5))).alias("ppv")), "shift", "left").select("auroc", "ppv", "shift")


_BOXES = f"""n AS (SELECT least(greatest(len(regexp_extract_all(text, 'the')), 1), 3) AS boxes FROM documents WHERE contains(text, 'the')), pmf AS (SELECT boxes, count(*) AS c FROM n GROUP BY 1), cdf AS (SELECT boxes, sum(c) OVER (ORDER BY boxes) / sum(c) OVER ()::DOUBLE AS hi, (sum(c) OVER (ORDER BY boxes) - c) / sum(c) OVER ()::DOUBLE AS lo FROM pmf),
u AS (SELECT i AS item, {_H("'17|' || CAST(i AS VARCHAR)")} / 1152921504606846976.0::DOUBLE AS u FROM (SELECT unnest(range(1000)) AS i))"""


@query("b12_empirical_draws", f"WITH {_BOXES} SELECT item, boxes FROM u JOIN cdf ON u >= lo AND u < hi")
def b12d(s, d):
    """1000 numbers of boxes drawn from the empirical distribution (1 to 3) through its inverse."""
    n = table(s, d, "documents").where(F.contains("text", F.lit("the"))).select(F.least(F.greatest(F.regexp_count("text", F.lit("the")), F.lit(1)), F.lit(3)).cast("long").alias("boxes"))
    return B.empirical_draws(n, "boxes", 1000, 17).select("item", "boxes")


# ---- models


def _features(s, d):
    m = manifest(s, d).where("fold_r0 >= 0")
    return m.select("filepath", "label_int", "centre", F.col("fold_r0").alias("fold"), (F.col("file_size") / 1e4).alias("size"), F.col("has_redaction").cast("double").alias("redacted"), (F.col("image_id") % 3).cast("double").alias("third"), ((F.col("image_id") * 31 + 400 * F.col("label_int")) % 1009 / 100.0).alias("texture"))


@query("d11_bimodality")
def d11(s, d):
    """Of the scores of seed 0, and of the negatives' alone."""
    p = pred(s, d).where("seed = 0")
    one = lambda df, n: MO.bimodality(df, "logit").withColumn("indicator", F.lit(n))
    return one(p.withColumn("logit", F.col("logit") + 6 * F.col("label_int")), "apart").unionByName(one(p.where("label_int = 0"), "negatives"))


@query("d15_logistic_auc")
def d15(s, d):
    """The AUC of each fold under a logistic model of the other folds on four manifest features."""
    scored = MO.cross_validated_logistic(_features(s, d), ["size", "redacted", "third", "texture"], "label_int", "fold")
    return R.curve(scored, ["fold"], score="score").groupBy("fold").agg(r6(R.auc()).alias("roc_auc"))


@query("d16_forest_auc")
def d16(s, d):
    """Pooled out-of-fold AUC of a forest and of a logistic model, the largest of both against 0.90, and the importances."""
    names = [f"x{i}" for i in range(12)]
    e = table(s, d, "embeddings").select("vec_id", (F.col("label") < 2).cast("int").alias("label_int"), (F.xxhash64("vec_id") % 5 + 4).cast("int").alias("fold"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)])
    forest, weights = MO.forest_scores(e, names, "label_int", "fold", trees=300, depth=5, seed=20260807)
    auc = lambda df: R.curve(df, [], score="score").agg(R.auc().alias("auc"))
    both = auc(forest).select(F.col("auc").alias("forest")).crossJoin(auc(MO.cross_validated_logistic(e, names, "label_int", "fold")).select(F.col("auc").alias("logistic")))  # one row each
    top = F.lit(json.dumps([[n, round(w, 4)] for n, w in weights]))
    return both.select(F.round("forest", 4).alias("forest_auc"), F.round("logistic", 4).alias("logistic_auc"), (F.greatest("forest", "logistic") >= 0.90).alias("voided"), top.alias("importances"))


@query("g12_ward_clusters")
def g12(s, d):
    """Ward clusters of standardised features at both thresholds: their number, the largest, and whether it is degenerate."""
    e = table(s, d, "embeddings").select("vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)], F.col("label").cast("double").alias("label"))
    out = None
    for t in (3.0, 5.0):
        sizes = MO.ward_clusters(e, "vec_id", ["x0", "x1", "x2", "x3", "label"], t).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
        row = sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), (F.max("n") > 0.2 * F.sum("n")).alias("degenerate")).withColumn("threshold", F.lit(t))
        out = row if out is None else out.unionByName(row)
    return out


# ---- timing and bounded-time scoring


@query("a28_median_of_passes", "WITH t AS (SELECT user_id % 10 AS item, event_id % 3 AS pass, avg(value) AS ms FROM events GROUP BY 1, 2), m AS (SELECT item, quantile_cont(ms, 0.5) AS ms FROM t GROUP BY item) SELECT round(sum(ms * ((item + 1) / 10.0::DOUBLE)), 6) AS budget_ms, round(max(ms), 6) AS slowest FROM m")
def a28(s, d):
    """The median time of each item over passes; the budget weighs it by the chance that the item runs."""
    t = table(s, d, "events").groupBy((F.col("user_id") % 10).alias("item"), (F.col("event_id") % 3).alias("pass")).agg(F.avg("value").alias("ms"))
    m = Y.median_of_passes(t, "item", "ms")
    return m.agg(r6(F.sum(F.col("ms") * ((F.col("item") + 1) / 10.0))).alias("budget_ms"), r6(F.max("ms")).alias("slowest"))


def _ladders(s, d):
    return batches(s, d).withColumn("run", F.col("batch") % 3)


@query("y03_ladder")
def y03l(s, d):
    """The ladder over each run's batches, one step a batch: views to one, members to one, stop; budget and hard stop are
    shares of the run's own time."""
    total = WN.with_group(_ladders(s, d), ["run"], whole=F.sum("seconds"))
    return Y.ladder(total.withColumn("seconds", F.col("seconds") * 900 / F.col("whole")), ["run"], budget=540.0, hard_stop=480.0, views=4, members=5)


@query("y06_governors")
def y06g(s, d):
    """The cumulative governor against the trailing one over the same batches: coverage, seconds, and whether it was killed."""
    return Y.governors(_ladders(s, d), ["run"], budget=300.0, limit=600.0, passes=5)


@query("y09_epoch_addressed", f"SELECT event_id AS item, e AS epoch, {_H("'5|' || CAST(e AS VARCHAR) || '|' || CAST(event_id AS VARCHAR)")} AS h FROM events, (SELECT unnest(range(3)) AS e)")
def y09(s, d):
    """An item's random number in an epoch follows from seed, epoch and item alone, whichever worker computes it."""
    e = table(s, d, "events").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return e.select(F.col("event_id").alias("item"), "epoch", draw(5, F.col("epoch"), F.col("event_id")).alias("h"))


@query(
    "y08_statistics",
    f"""WITH {BATCHES_SQL}, e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 13 = 0 THEN 'no content' WHEN event_id % 17 = 0 THEN 'poor fit' END AS reason FROM events)
SELECT count(*) AS items, count(DISTINCT value) AS distinct_scores, count(DISTINCT event_type) AS distinct_inputs, count(reason) AS fallbacks, count(*) FILTER (reason = 'no content') AS no_content, count(*) FILTER (reason = 'poor fit') AS poor_fit, round(100.0 * count(reason) / count(*), 4) AS fallback_pct,
round(min(value), 6) AS least, round(max(value), 6) AS most, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(stddev_samp(value), 6) AS sd,
(SELECT count(*) FROM batches) AS batches, (SELECT round(max(seconds), 4) FROM batches) AS slowest, (SELECT round(sum(n_items) / sum(seconds), 4) FROM batches) AS rate FROM e""",
)
def y08s(s, d):
    reason = F.when(F.col("event_id") % 13 == 0, "no content").when(F.col("event_id") % 17 == 0, "poor fit")
    e = table(s, d, "events").withColumn("reason", reason)
    n = F.count(F.lit(1))
    q = lambda p: r6(F.percentile("value", F.lit(p)))
    one = e.agg(
        n.alias("items"), F.countDistinct("value").alias("distinct_scores"), F.countDistinct("event_type").alias("distinct_inputs"), F.count("reason").alias("fallbacks"), count_if(F.col("reason") == "no content").alias("no_content"), count_if(F.col("reason") == "poor fit").alias("poor_fit"),
        F.round(100.0 * F.count("reason") / n, 4).alias("fallback_pct"), r6(F.min("value")).alias("least"), r6(F.max("value")).alias("most"), r6(F.avg("value")).alias("mean"), q(0.5).alias("median"), q(0.95).alias("p95"), q(0.99).alias("p99"), r6(F.stddev_samp("value")).alias("sd"),
    )
    b = batches(s, d).agg(F.count(F.lit(1)).alias("batches"), F.round(F.max("seconds"), 4).alias("slowest"), F.round(F.sum("n_items") / F.sum("seconds"), 4).alias("rate"))
    return one.crossJoin(b)  # one row each


# ---- sources, sinks and settings


@query("s02_csv_branch", "SELECT n_nationkey, n_name, n_regionkey, CASE WHEN n_nationkey % 4 <> 0 THEN 'bad ' || n_name ELSE '' END AS load_error FROM nation")
def s02c(s, d):
    """A CSV by its suffix; empty errors, which CSV reads as nulls, are empty strings again."""
    f = f"{temporary_folder(s)}.csv"
    error = F.when(F.col("n_nationkey") % 4 != 0, F.concat(F.lit("bad "), "n_name"))
    table(s, d, "nation").withColumn("load_error", error).write.option("header", True).csv(f)
    return readers.read_table(s, f, "n_nationkey int, n_name string, n_regionkey int, load_error string").na.fill("", ["load_error"])


@query("s14_training_log", "SELECT user_id AS unit, max(event_id % 50) AS epoch, max(event_id) AS last_start FROM events WHERE event_id % 9 <> 4 GROUP BY user_id")
def s14l(s, d):
    """A log of JSON lines with broken ones: bad lines are passed over, the highest epoch and the last start win."""
    f = temporary_folder(s)
    line = F.when(F.col("event_id") % 9 == 4, F.concat(F.lit('{"unit": '), F.col("user_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("user_id").alias("unit"), (F.col("event_id") % 50).alias("epoch"), F.col("event_id").alias("run_start"))))
    table(s, d, "events").select(line.alias("value")).write.text(f)
    log = readers.read_json_lines(s, f, "unit long, epoch long, run_start long").where("_corrupt_record is null")
    return log.groupBy("unit").agg(F.max("epoch").alias("epoch"), F.max("run_start").alias("last_start"))


@query("s15_json_over_log", "SELECT user_id AS unit, round(CASE WHEN user_id % 2 = 0 THEN -1.0::DOUBLE ELSE max(value) END, 6) AS best FROM events GROUP BY 1")
def s15j(s, d):
    """Metrics from a log's segments; a JSON summary, where there is one, overrides them."""
    f, g = temporary_folder(s), temporary_folder(s)
    e = table(s, d, "events")
    e.select(F.format_string("RUN unit=%d value=%s end", "user_id", F.col("value").cast("string"))).write.text(f)
    sinks.write_report(e.where("user_id % 2 = 0").select(F.col("user_id").alias("unit"), F.lit(-1.0).alias("best")).distinct(), g)
    part = lambda p: F.regexp_extract("value", p, 1)
    log = readers.read_lines(s, f).groupBy(part("unit=([0-9]+)").cast("long").alias("unit")).agg(F.max(part("value=([-0-9.E]+)").cast("double")).alias("logged"))
    return log.join(readers.read_json_lines(s, g, "unit long, best double").select("unit", "best"), "unit", "left").select("unit", r6(F.coalesce("best", "logged")).alias("best"))


@query("s18_settings", "SELECT 'pauc' AS loss, CAST(16 AS BIGINT) AS batch_size, CAST(30 AS BIGINT) AS epochs, true AS empty_gives_defaults")
def s18(s, d):
    f, g = temporary_folder(s), temporary_folder(s)
    s.createDataFrame([("loss: pauc\nbatch_size: 16",)], "value string").coalesce(1).write.text(f)
    s.createDataFrame([("# nothing",)], "value string").coalesce(1).write.text(g)
    c, empty = settings.read_settings(s, f), settings.read_settings(s, g)
    return s.createDataFrame([(c.loss, c.batch_size, c.epochs, empty == settings.Settings())], "loss string, batch_size long, epochs long, empty_gives_defaults boolean")


@query("v11_setting_checks", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'loss must be one of bce, pauc'), (1, 'flip_p must lie in [0, 1]'), (2, 'gamma_min must not exceed gamma_max')) t(position, problem)")
def v11(s, d):
    from dataclasses import replace

    bad = settings.violations(replace(settings.Settings(), loss="other", flip_p=1.5, gamma_min=2.0))
    return s.createDataFrame(list(enumerate(bad)), "position long, problem string")


@query("v12_resume_mismatches", "SELECT * FROM (VALUES ('batch_size'), ('lr')) t(setting)")
def v12(s, d):
    from dataclasses import asdict, replace

    a = settings.Settings()
    return s.createDataFrame([(n,) for n in settings.mismatches(asdict(a), asdict(replace(a, lr=1.0, batch_size=8, magnitude_scale=0.5)))], "setting string")


_TABLE = "SELECT CAST(row_number() OVER (ORDER BY lang) + 1 AS BIGINT) AS position, concat('| ', lang, ' | ', count(*), ' |') AS line FROM documents WHERE lang IS NOT NULL GROUP BY lang"


@query("k06_markdown_table", f"SELECT CAST(0 AS BIGINT) AS position, '| lang | n |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL {_TABLE}")
def k06(s, d):
    g = table(s, d, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return s.createDataFrame(list(enumerate(reports.markdown_table(g, ["lang"]).splitlines())), "position long, line string")


@query("k07_data_dictionary", "SELECT * FROM (VALUES (0, 'r_regionkey', 'int', 'source', 'its number'), (1, 'r_name', 'string', 'source', 'its name')) t(\"position\", \"column\", \"type\", producer, meaning)")
def k07(s, d):
    return reports.data_dictionary(reports.described(table(s, d, "region").select("r_regionkey", "r_name"), {"r_regionkey": ("source", "its number"), "r_name": ("source", "its name")}))


@query("k13_spliced_report", "SELECT * FROM (VALUES ('anchored', 'a\n<b>new<e>\n## x\nz'), ('appended', 'a\n\n<b>new<e>\n'), ('replaced', 'a\n<b>new<e>\nz')) t(kind, text)")
def k13(s, d):
    put = lambda text: reports.splice(text, "<b>", "<e>", "<b>new<e>", "## x", before=True)
    texts = {"replaced": "a\n<b>old<e>\nz", "anchored": "a\n## x\nz", "appended": "a\n"}
    return s.createDataFrame([(k, put(put(t))) for k, t in texts.items()], "kind string, text string")


@query("k05_checked_list", "SELECT user_id, list(value ORDER BY event_id) AS scores, count(DISTINCT value) = count(*) AS distinct_scores FROM events GROUP BY user_id")
def k05c(s, d):
    """The bare list of each user's scores in order, written as JSON, read again and checked for distinct values."""
    f = temporary_folder(s)
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    table(s, d, "events").groupBy("user_id").agg(F.to_json(F.transform(rows, lambda x: x["value"])).alias("scores")).write.json(f)
    back = s.read.schema("user_id long, scores string").json(f).withColumn("scores", F.from_json("scores", "array<double>"))
    return back.select("user_id", "scores", (F.size(F.array_distinct("scores")) == F.size("scores")).alias("distinct_scores"))


@query("k10_canonical_rewrite", f"WITH {PRED_SQL}, pos AS (SELECT filepath, row_number() OVER (ORDER BY centre, filepath) - 1 AS position FROM manifest WHERE label_int = 1) SELECT position, filepath, CASE WHEN position % 3 = 0 THEN 'new note' ELSE 'old note' END AS note FROM pos WHERE position % 2 = 0 OR position % 3 = 0")
def k10c(s, d):
    """Reviewed rows take the place of old ones with their key; the file follows the list of positives' order."""
    pos = manifest(s, d).where("label_int = 1").select("filepath", "centre")
    listed = WN.numbered(pos, [], "centre", "filepath").select("filepath", (F.col("rn") - 1).cast("long").alias("position"))
    old = listed.where("position % 2 = 0").select("filepath", F.lit("old note").alias("note"))
    new = listed.where("position % 3 = 0").select("filepath", F.lit("new note").alias("note"))
    return sinks.upsert(old, new, ["filepath"]).join(listed, "filepath").orderBy("position").select("position", "filepath", "note")


@query("k11_digest_registry", f"WITH {DUPS_SQL}, g AS (SELECT centre, class_label, sha256(string_agg(sha256_hash, '' ORDER BY sha256_hash)) AS digest, min(doc_id) AS run FROM dups WHERE doc_id % 10 = 3 GROUP BY 1, 2) SELECT digest, min(run) AS earliest, count(*) AS snapshots FROM g GROUP BY digest")
def k11d(s, d):
    """Snapshots by the digest of their files; of each digest the earliest run. (Snapshots are few files by definition.)"""
    g = dups(s, d).where("doc_id % 10 = 3").groupBy("centre", "class_label").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256_hash")), ""), 256).alias("digest"), F.min("doc_id").alias("run"))
    return g.groupBy("digest").agg(F.min("run").alias("earliest"), F.count(F.lit(1)).alias("snapshots"))


# ---- checks

_DUMP = f"""x AS (SELECT seed, fold, filepath, label_int, CASE WHEN fold = 3 AND seed = 1 THEN 1.0::DOUBLE WHEN fold = 2 AND seed = 1 AND image_id % 41 = 0 THEN 'nan'::DOUBLE ELSE logit END AS logit, CASE WHEN fold = 4 AND seed = 2 THEN 9 ELSE seed END AS own_seed, CASE WHEN fold = 4 AND seed = 3 THEN 0 ELSE fold END AS own_fold FROM pred WHERE fold >= 0 AND NOT (seed = 0 AND fold = 1) AND NOT (seed = 0 AND fold = 2 AND image_id % 5 = 0)),
y AS (SELECT * FROM x UNION ALL SELECT * FROM (SELECT x.* FROM x WHERE seed = 4 AND fold = 0 ORDER BY filepath LIMIT 1)),
want AS (SELECT fold, count(*) AS n, sum(label_int) AS p FROM pred WHERE seed = 0 AND fold >= 0 GROUP BY fold), grid AS (SELECT s AS seed, fold, n, p FROM want, (SELECT unnest(range(5)) AS s)),
u AS (SELECT seed, fold, count(*) AS n, sum(label_int) AS p, count(DISTINCT filepath) AS ids, count(*) FILTER (own_seed <> seed) AS bs, count(*) FILTER (own_fold <> fold) AS bf, count(*) FILTER (isnan(logit)) AS bad, count(DISTINCT logit) AS v FROM y GROUP BY 1, 2)"""


@query(
    "v04_eight_checks",
    f"""WITH {PRED_SQL}, {_DUMP} SELECT g.seed, g.fold, CASE WHEN u.n IS NULL THEN 'absent' WHEN u.n <> g.n + CASE WHEN g.seed = 4 AND g.fold = 0 THEN 1 ELSE 0 END THEN 'row count' WHEN u.ids < u.n THEN 'duplicates' WHEN u.p <> g.p THEN 'class counts' WHEN bs > 0 THEN 'seed mismatch' WHEN bf > 0 THEN 'fold mismatch' WHEN bad > 0 THEN 'not finite' WHEN v <= 1 THEN 'degenerate' ELSE 'ok' END AS reason
FROM grid g LEFT JOIN u ON u.seed = g.seed AND u.fold = g.fold""",
)
def v04e(s, d):
    """Units with one planted fault each, against the expected counts of the grid; the first fault gives the reason."""
    p = pred(s, d).where("fold >= 0")
    at = lambda seed, fold: (F.col("seed") == seed) & (F.col("fold") == fold)
    x = p.where(~at(0, 1) & ~(at(0, 2) & (F.col("image_id") % 5 == 0)))
    logit = F.when(at(1, 3), 1.0).when(at(1, 2) & (F.col("image_id") % 41 == 0), float("nan")).otherwise(F.col("logit"))
    x = x.select("seed", "fold", "filepath", "label_int", logit.alias("logit"), F.when(at(2, 4), 9).otherwise(F.col("seed")).alias("own_seed"), F.when(at(3, 4), 0).otherwise(F.col("fold")).alias("own_fold"))
    x = x.unionByName(x.where(at(4, 0)).orderBy("filepath").limit(1))
    want = p.where("seed = 0").groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label_int").alias("n_pos"))
    grid = want.withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    grid = grid.withColumn("n_rows", F.col("n_rows") + at(4, 0).cast("int"))
    from ..operators.curation import validate_units

    return validate_units(x, grid, ["seed", "fold"], {"own_seed": "seed", "own_fold": "fold"}).select("seed", "fold", "reason")
