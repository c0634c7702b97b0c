"""File formats, upserts, further decision rules and ordered scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import count_if, r6
from ..operators import diagnostics as D
from ..operators import ranking as R
from ..operators import relational as L
from ..operators import rules as RU
from ..sources import readers, sinks
from ..sources.predictions import load_units, read_predictions, temporary_folder, write_predictions
from ..streaming.scoring import score_by_index
from .bindings import BATCHES_SQL, PRED_SQL, batches, manifest, pred, table
from .decision_queries import _ARMS, _arms
from .metric_queries import _block_sql
from .registry import query

_NATION = "n_nationkey int, n_name string, n_regionkey int"


@query("s01_csv_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def s01(s, d):
    f = temporary_folder(s)
    table(s, d, "nation").write.option("header", True).csv(f)
    return readers.read_table(s, f, _NATION)


@query("s02_suffix_dispatch", "SELECT r_regionkey, r_name FROM region")
def s02(s, d):
    return readers.read_table(s, f"{d}/region.parquet").select("r_regionkey", "r_name")


@query("s04_unit_loader", f"WITH {PRED_SQL} SELECT filepath, round(logit, 6) AS logit FROM pred WHERE seed = 2 AND fold = 1")
def s04(s, d):
    f = temporary_folder(s)
    write_predictions(pred(s, d).withColumnRenamed("group_id", "group_id_v2"), f)
    return load_units(s, f, repeat=0, seed=2, folds=[1]).select("filepath", r6("logit").alias("logit"))


@query("s13_json_documents", "SELECT n_nationkey, n_name FROM nation")
def s13(s, d):
    f = temporary_folder(s)
    sinks.write_report(table(s, d, "nation"), f)
    return readers.read_json_lines(s, f, _NATION).select("n_nationkey", "n_name")


@query("s15_log_segments", "SELECT CAST(user_id AS BIGINT) AS unit, round(max(value), 6) AS best FROM events GROUP BY 1")
def s15w(s, d):
    f = temporary_folder(s)
    table(s, d, "events").select(F.format_string("RUN unit=%d value=%s end", "user_id", F.col("value").cast("string"))).write.text(f)
    part = lambda p: F.regexp_extract("value", p, 1)
    return readers.read_lines(s, f).groupBy(part("unit=([0-9]+)").cast("long").alias("unit")).agg(r6(F.max(part("value=([-0-9.E]+)").cast("double"))).alias("best"))


@query("s17_list_file", f"WITH {PRED_SQL} SELECT filepath, centre FROM manifest WHERE image_id % 20 = 0")
def s17(s, d):
    f = temporary_folder(s)
    m = manifest(s, d)
    m.where("image_id % 20 = 0").select("filepath").write.text(f)
    return m.join(readers.read_lines(s, f).withColumnRenamed("value", "filepath"), "filepath", "left_semi").select("filepath", "centre")


@query("k01_validated_write", f"WITH {PRED_SQL} SELECT count(*) AS n, count(DISTINCT filepath) AS ids FROM pred")
def k01(s, d):
    f = temporary_folder(s)
    write_predictions(pred(s, d).withColumnRenamed("group_id", "group_id_v2"), f)
    return read_predictions(s, f).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("filepath").alias("ids"))


@query("k02_twin_write", "SELECT n_nationkey, n_name, n_regionkey, true AS same FROM nation")
def k02(s, d):
    f = temporary_folder(s)
    sinks.write_twins(table(s, d, "nation"), f)
    a, b = s.read.parquet(f"{f}/data.parquet"), readers.read_table(s, f"{f}/data.csv", _NATION)
    return a.join(b.withColumn("same", F.lit(True)), ["n_nationkey", "n_name", "n_regionkey"], "left")


@query("k03_json_report", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def k03(s, d):
    f = temporary_folder(s)
    g = table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))
    sinks.write_report(g.select("lang", F.struct("n", "chars").alias("level")), f)
    return s.read.schema("lang string, level struct<n: long, chars: long>").json(f).select("lang", "level.n", "level.chars")


@query("k04_append_lines", "SELECT r_regionkey, count(*) AS n FROM (SELECT * FROM region UNION ALL SELECT * FROM region) GROUP BY 1")
def k04(s, d):
    f = temporary_folder(s)
    for _ in range(2):
        sinks.append_json_lines(table(s, d, "region"), f)
    return readers.read_json_lines(s, f, "r_regionkey int, r_name string").groupBy("r_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("k12_upsert_by_label", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation")
def k12(s, d):
    n = table(s, d, "nation").select("n_nationkey", "n_name")
    return sinks.upsert(n, n.where("n_nationkey % 3 = 0").withColumn("n_name", F.lit("new")), ["n_nationkey"])


@query("d18_geometry_summary", "SELECT event_type, round(avg(value / (1 + event_id % 7)), 6) AS mean, round(quantile_cont(value / (1 + event_id % 7), 0.5), 6) AS median, count(*) FILTER (event_id % 7 = 0) AS fallbacks FROM events GROUP BY event_type")
def d18(s, d):
    e = table(s, d, "events").withColumn("r", F.col("value") / (1 + F.col("event_id") % 7))
    return e.groupBy("event_type").agg(r6(F.avg("r")).alias("mean"), r6(F.percentile("r", F.lit(0.5))).alias("median"), count_if(F.col("event_id") % 7 == 0).alias("fallbacks"))


_AVG = lambda v: f"(rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE)"


@query("d09_confound_bundle", f"WITH {PRED_SQL}, j AS (SELECT logit, file_size, CASE WHEN has_redaction THEN 1.0::DOUBLE ELSE 0 END AS red FROM pred p JOIN (SELECT filepath AS f, file_size, has_redaction FROM manifest) m ON f = p.filepath WHERE seed = 0), r AS (SELECT {_AVG('logit')} AS a, {_AVG('file_size')} AS b, {_AVG('red')} AS c FROM j) SELECT 'file_size' AS field, round(corr(a, b), 6) AS rho FROM r UNION ALL SELECT 'has_redaction', round(corr(a, c), 6) FROM r")
def d09(s, d):
    j = pred(s, d).where("seed = 0").join(manifest(s, d).select("filepath", "file_size", F.col("has_redaction").cast("double").alias("red")), "filepath")
    one = lambda c, n: D.spearman(j, [], "logit", c).select(F.lit(n).alias("field"), r6("rho").alias("rho"))
    return one("file_size", "file_size").unionByName(one("red", "has_redaction"))


@query("e09_cross_repeat_pool", f"WITH {PRED_SQL}, en AS (SELECT filepath, fold, max(label_int) AS label_int, avg(logit) AS logit FROM pred WHERE fold >= 0 GROUP BY 1, 2), {_block_sql('fold', 'en')} SELECT round(quantile_cont(roc_auc, 0.5), 6) AS median, round(quantile_cont(roc_auc, 0.75) - quantile_cont(roc_auc, 0.25), 6) AS bar FROM block")
def e09(s, d):
    en = pred(s, d).where("fold >= 0").groupBy("filepath", "fold", "label_int").agg(F.avg("logit").alias("logit"))
    b = R.curve(en, ["fold"]).groupBy("fold").agg(R.auc().alias("roc_auc"))
    q = F.percentile("roc_auc", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return b.agg(q.alias("q")).select(r6(F.get("q", F.lit(1))).alias("median"), r6(F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("bar"))


@query("r04_generalisation_gate", f"WITH {_ARMS} SELECT arm, bool_and(control > treatment) AND bool_or(control - treatment > iqr_control) AND (max(control) - min(control)) - (max(treatment) - min(treatment)) > max(iqr_treatment) AND NOT bool_or(treatment > 0.095) AS passed FROM arms GROUP BY arm")
def r04(s, d):
    g = _arms(s).groupBy("arm").agg(
        F.bool_and(F.col("control") > F.col("treatment")).alias("a"), F.bool_or(F.col("control") - F.col("treatment") > F.col("iqr_control")).alias("b"),
        ((F.max("control") - F.min("control")) - (F.max("treatment") - F.min("treatment")) > F.max("iqr_treatment")).alias("c"), F.bool_or(F.col("treatment") > 0.095).alias("veto"),
    )
    return g.select("arm", (F.col("a") & F.col("b") & F.col("c") & ~F.col("veto")).alias("passed"))


@query("r07_confound_distance", f"WITH {_ARMS} SELECT arm, direction, abs(treatment - 0.05) - abs(control - 0.05) > iqr_control AS farther FROM arms")
def r07(s, d):
    return _arms(s).select("arm", "direction", (F.abs(F.col("treatment") - 0.05) - F.abs(F.col("control") - 0.05) > F.col("iqr_control")).alias("farther"))


@query(
    "r12_paired_verdict",
    f"""WITH {_ARMS}, q AS (SELECT arm % 2 AS family, direction, control - treatment AS delta FROM arms), m AS (SELECT family, direction, quantile_cont(delta, 0.5) AS median FROM q GROUP BY 1, 2),
g AS (SELECT q.family, q.direction, max(median) > 0 AND count(*) FILTER ((delta > 0) = (median > 0)) >= 4 AS ok FROM q JOIN m ON q.family = m.family AND q.direction = m.direction GROUP BY 1, 2) SELECT family, bool_and(ok) AS passed FROM g GROUP BY family""",
)
def r12(s, d):
    deltas = _arms(s).select((F.col("arm") % 2).alias("family"), "direction", F.col("arm").alias("seed"), (F.col("control") - F.col("treatment")).alias("delta"))
    g = RU.paired_sign(deltas, ["family", "direction"], 4)
    return g.groupBy("family").agg(F.bool_and(F.col("verdict") == "accept").alias("passed"))


@query("v05_unit_states", f"WITH {PRED_SQL}, g AS (SELECT s AS seed, f AS fold FROM (SELECT unnest(range(7)) AS s), (SELECT unnest(range(5)) AS f)), u AS (SELECT seed, fold, count(*) AS n FROM pred GROUP BY 1, 2) SELECT g.seed, g.fold, CASE WHEN u.n IS NULL THEN 'fresh' WHEN u.n < 280 THEN 'resume' ELSE 'done' END AS state FROM g LEFT JOIN u ON g.seed = u.seed AND g.fold = u.fold")
def v05(s, d):
    n = pred(s, d).groupBy("seed", "fold").agg(F.count(F.lit(1)).alias("n"))
    grid = L.unit_grid(s, repeats=1, seeds=7, folds=5).select("seed", "fold")
    return grid.join(n, ["seed", "fold"], "left").select("seed", "fold", F.when(F.col("n").isNull(), "fresh").when(F.col("n") < 280, "resume").otherwise("done").alias("state"))


@query("y01_ordered_scoring", "SELECT event_id, round(1 / (1 + exp(-value / 100)), 6) AS score FROM events")
def y01(s, d):
    import numpy as np

    return score_by_index(table(s, d, "events"), "event_id", "value", lambda x: 1 / (1 + np.exp(-x / 100))).select("event_id", r6("score").alias("score"))


@query("y03_degradation_ladder", f"WITH {BATCHES_SQL}, r AS (SELECT batch, sum(seconds) OVER (ORDER BY batch ROWS UNBOUNDED PRECEDING) AS elapsed, batch + 1 AS done, count(*) OVER () AS total FROM batches) SELECT batch, CASE WHEN elapsed / done * total > 100000 THEN 'stop' WHEN elapsed / done * total > 30000 THEN 'one pass' ELSE 'all passes' END AS step FROM r")
def y03(s, d):
    from ..operators import scoring as Y
    from ..operators import windows as WN

    b = WN.with_group(batches(s, d).withColumn("run", F.lit(0)), ["run"], total=F.count(F.lit(1)))
    run = Y.progress(b, ["run"], F.col("total"))
    end = F.col("elapsed") / (F.col("batch") + 1) * F.col("total")
    return run.select("batch", F.when(end > 100000, "stop").when(end > 30000, "one pass").otherwise("all passes").alias("step"))
