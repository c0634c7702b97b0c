"""Projections, filters, joins, aggregations, set operations and ordering."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import count_if, draw, keyword_case, r6
from ..operators import diagnostics as D
from ..operators import relational as L
from ..operators import windows as WN
from .bindings import BATCHES_SQL, DUPS_SQL, MANIFEST_SQL, PRED_SQL, batches, dups, manifest, pred, table
from .registry import query

_HASH = "cast('0x' || substr(sha256({}), 1, 15) AS BIGINT)"


def _m(name, sql, spark=None):
    """A query over the manifest: the same clauses in both engines, or a DataFrame function of it."""

    def put(f):
        return query(name, f"WITH {MANIFEST_SQL} {sql}")(lambda s, d: f(manifest(s, d)))

    return put


# ---- projections and filters


@_m("p01_sentinel_filter", "SELECT filepath, CAST(fold_r0 AS BIGINT) AS fold FROM manifest WHERE fold_r0 <> -1")
def p01(m):
    return m.where("fold_r0 <> -1").select("filepath", F.col("fold_r0").alias("fold"))


@_m("p02_cv_split", "SELECT filepath, fold_r3 = 2 AS is_val FROM manifest WHERE fold_r3 <> -1")
def p02(m):
    train, val = L.cv_split(m, 3, 2)
    return train.select("filepath", F.lit(False).alias("is_val")).unionByName(val.select("filepath", F.lit(True).alias("is_val")))


@_m("p03_full_data", "SELECT count(*) AS n FROM manifest WHERE fold_r0 <> -1")
def p03(m):
    return m.where("fold_r0 <> -1").agg(F.count(F.lit(1)).alias("n"))


@_m("p04_holdout_split", "SELECT filepath, centre = 'center_2' AS is_test FROM manifest WHERE centre = 'center_2' OR fold_r0 <> -1")
def p04(m):
    train, test = L.holdout_split(m, "center_2")
    return train.select("filepath", F.lit(False).alias("is_test")).unionByName(test.select("filepath", F.lit(True).alias("is_test")))


@_m("p05_masks", "SELECT filepath FROM manifest WHERE centre = 'center_1' AND NOT has_redaction AND keep_for_training = true")
def p05(m):
    return m.where((F.col("centre") == "center_1") & ~F.col("has_redaction") & F.col("keep_for_training")).select("filepath")


@_m("p06_membership", "SELECT filepath FROM manifest WHERE group_id IN (SELECT group_id FROM manifest WHERE label_int = 1) AND group_id NOT IN (SELECT group_id FROM manifest WHERE visibility = 'moderate')")
def p06(m):
    return m.join(m.where("label_int = 1").select("group_id"), "group_id", "left_semi").join(m.where("visibility = 'moderate'").select("group_id"), "group_id", "left_anti").select("filepath")


@_m("p07_nulls", "SELECT filepath, coalesce(visibility, 'none') AS visibility FROM manifest WHERE visibility IS NOT NULL OR label_int = 0")
def p07(m):
    return m.where(F.col("visibility").isNotNull() | (F.col("label_int") == 0)).fillna({"visibility": "none"}).select("filepath", "visibility")


@query("p09_numeric_coercion", "SELECT event_id, try_cast(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE) AS v FROM events")
def p09(s, d):
    return table(s, d, "events").selectExpr("event_id", "try_cast(CASE WHEN event_id % 7 = 0 THEN 'bad' ELSE CAST(user_id AS STRING) END AS DOUBLE) AS v")


@_m("p10_binary_columns", "SELECT bool_and(label_int IN (0, 1)) AS label_binary, bool_and(fold_r0 IN (0, 1)) AS fold_binary FROM manifest")
def p10(m):
    return m.agg(F.bool_and(F.col("label_int").isin(0, 1)).alias("label_binary"), F.bool_and(F.col("fold_r0").isin(0, 1)).alias("fold_binary"))


@_m("p11_concat_key", "SELECT concat_ws('_', CAST(group_id AS VARCHAR), centre) AS group_id_v2, count(*) AS n FROM manifest GROUP BY 1")
def p11(m):
    return m.groupBy(F.concat_ws("_", F.col("group_id").cast("string"), "centre").alias("group_id_v2")).agg(F.count(F.lit(1)).alias("n"))


@_m("p12_conditional", "SELECT filepath, CASE WHEN file_size < 100000 THEN 'NBI' ELSE 'WLE' END AS modality FROM manifest")
def p12(m):
    return m.select("filepath", F.when(F.col("file_size") < 100000, "NBI").otherwise("WLE").alias("modality"))


@_m("p13_dictionary_map", "SELECT filepath, CAST(CASE class_label WHEN 'neoplasia' THEN 1 WHEN 'non-dysplastic' THEN 0 END AS BIGINT) AS y FROM manifest")
def p13(m):
    codes = F.create_map(F.lit("neoplasia"), F.lit(1), F.lit("non-dysplastic"), F.lit(0))
    return m.select("filepath", F.element_at(codes, F.col("class_label")).cast("long").alias("y"))


@_m("p14_permutation", f"SELECT filepath, row_number() OVER (ORDER BY {_HASH.format(chr(39) + '7|' + chr(39) + ' || filepath')}, filepath) AS position FROM manifest")
def p14(m):
    return L.permuted(m, 7, "filepath").select("filepath", "position")


@_m("p15_tolerant_projection", "SELECT filepath, centre FROM manifest")
def p15(m):
    return L.present(m, ["filepath", "no_such_column", "centre"])


@query("p16_score_substitution", f"WITH {PRED_SQL} SELECT filepath, round(-logit, 6) AS logit FROM pred WHERE seed = 1")
def p16(s, d):
    return L.score_as_logit(pred(s, d).where("seed = 1").withColumn("other", -F.col("logit")), "other").select("filepath", r6("logit").alias("logit"))


# ---- joins


@query("j01_consolidation", f"WITH {MANIFEST_SQL} SELECT filepath, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM manifest LEFT JOIN customer ON group_id = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j01(s, d):
    c, n, r = (table(s, d, t) for t in ("customer", "nation", "region"))
    out = L.consolidate(manifest(s, d).select("filepath", F.col("group_id").alias("c_custkey")), [(c, "c_custkey"), (n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey"), (r.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")])
    return out.select("filepath", F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("j02_left_join", f"WITH {MANIFEST_SQL} SELECT filepath, c_acctbal AS balance FROM manifest LEFT JOIN customer ON group_id = c_custkey")
def j02(s, d):
    return manifest(s, d).join(table(s, d, "customer").selectExpr("c_custkey AS group_id", "c_acctbal AS balance"), "group_id", "left").select("filepath", "balance")


@query("j03_suffix_join", f"WITH {PRED_SQL} SELECT p.filepath, p.centre, m.centre AS centre_manifest, p.seed FROM pred p LEFT JOIN manifest m ON p.filepath = m.filepath")
def j03(s, d):
    return L.suffix_join(pred(s, d), manifest(s, d).select("filepath", "centre"), "filepath", "_manifest").select("filepath", "centre", "centre_manifest", "seed")


@query("j04_aligned_join", f"WITH {PRED_SQL} SELECT a.filepath, round((a.logit + b.logit) / 2, 6) AS fused FROM pred a JOIN pred b ON a.filepath = b.filepath AND a.seed = 0 AND b.seed = 1")
def j04(s, d):
    p = pred(s, d)
    j = L.aligned_join(p.where("seed = 0"), p.where("seed = 1"), ["filepath"], "label_int")
    return j.select("filepath", r6((F.col("logit_a") + F.col("logit_b")) / 2).alias("fused"))


@_m("j05_lookup_default", "SELECT m.filepath, coalesce(k.keep, true) AS keep FROM manifest m LEFT JOIN (SELECT filepath, false AS keep FROM manifest WHERE image_id % 9 = 0) k ON m.filepath = k.filepath")
def j05(m):
    keep = m.where("image_id % 9 = 0").select("filepath", F.lit(False).alias("keep"))
    return m.select("filepath").join(keep, "filepath", "left").select("filepath", F.coalesce("keep", F.lit(True)).alias("keep"))


@query("j06_semi_join", f"WITH {DUPS_SQL} SELECT doc_id FROM dups WHERE sha256_hash IN (SELECT sha256_hash FROM dups GROUP BY 1 HAVING count(*) > 1)")
def j06(s, d):
    x = dups(s, d)
    return x.join(x.groupBy("sha256_hash").count().where("count > 1"), "sha256_hash", "left_semi").select("doc_id")


@_m("j07_leak_exclusion", "SELECT v.filepath FROM manifest v WHERE v.fold_r0 = 1 AND NOT EXISTS (SELECT 1 FROM manifest t WHERE t.fold_r0 NOT IN (1, -1) AND floor(t.file_size / 10) = floor(v.file_size / 10))")
def j07(m):
    g = m.withColumn("g", F.floor(F.col("file_size") / 10))
    return L.without_leaks(g.where("fold_r0 = 1"), g.where("fold_r0 not in (1, -1)"), ["g"]).select("filepath")


@query("j10_hash_one_to_many", f"WITH {DUPS_SQL} SELECT a.doc_id AS a, b.doc_id AS b FROM dups a JOIN dups b ON a.sha256_hash = b.sha256_hash AND a.centre < b.centre")
def j10(s, d):
    x = dups(s, d)
    return x.selectExpr("sha256_hash", "doc_id AS a", "centre AS ca").join(x.selectExpr("sha256_hash", "doc_id AS b", "centre AS cb"), "sha256_hash").where("ca < cb").select("a", "b")


@query("j11_grid", "SELECT s AS seed, r AS repeat, f AS fold, format('r{}_f{}_s{}', r, f, s) AS name FROM (SELECT unnest(range(5)) AS s), (SELECT unnest(range(3)) AS r), (SELECT unnest(range(5)) AS f)")
def j11(s, d):
    return L.unit_grid(s, repeats=3, seeds=5, folds=5)


@_m("j12_group_size", "SELECT filepath, count(*) OVER (PARTITION BY group_id) AS group_size FROM manifest")
def j12(m):
    return WN.with_group(m, ["group_id"], group_size=F.count(F.lit(1))).select("filepath", "group_size")


@query("j14_owner_lookup", f"WITH {PRED_SQL} SELECT filepath, round(logit, 6) AS own FROM pred WHERE fold >= 0 AND seed = fold")
def j14(s, d):
    p = pred(s, d)
    wide = p.groupBy("filepath", "fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("seed", "logit"))), lambda x: x["logit"]).alias("members"))
    return wide.where("fold >= 0").select("filepath", r6(F.get("members", F.col("fold").cast("int"))).alias("own"))


@query("j15_alias_chain", "WITH RECURSIVE a(key, same_as) AS (VALUES ('c0', NULL), ('c1', 'c0'), ('c2', 'c1'), ('c3', NULL), ('c4', 'c2')), r AS (SELECT key, key AS at FROM a UNION ALL SELECT r.key, a.same_as FROM r JOIN a ON r.at = a.key WHERE a.same_as IS NOT NULL) SELECT r.key, r.at AS resolved FROM r JOIN a ON r.at = a.key WHERE a.same_as IS NULL")
def j15(s, d):
    arms = s.createDataFrame([("c0", None), ("c1", "c0"), ("c2", "c1"), ("c3", None), ("c4", "c2")], "key string, same_as string")
    return L.resolve_aliases(arms)


@query("j13_threshold_join", f"WITH {PRED_SQL} SELECT p.seed, count(*) AS pairs FROM (SELECT * FROM pred WHERE label_int = 1) p JOIN (SELECT seed, logit FROM pred WHERE label_int = 0) n ON n.seed = p.seed AND n.logit > p.logit GROUP BY p.seed")
def j13(s, d):
    from ..operators.ranking import curve

    # Counted from the curve: each positive meets the negatives above it.
    return curve(pred(s, d), ["seed"]).groupBy("seed").agg(F.sum(F.col("pos") * (F.col("fp") - F.col("neg"))).cast("long").alias("pairs"))


# ---- aggregations


@_m("a01_group_count", "SELECT centre, class_label, count(*) AS n FROM manifest GROUP BY 1, 2")
def a01(m):
    return m.groupBy("centre", "class_label").agg(F.count(F.lit(1)).alias("n"))


@_m("a02_frequencies", "SELECT mode, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM manifest GROUP BY mode")
def a02(m):
    return L.frequencies(m, "mode").select("mode", "n", r6("share").alias("share"))


@_m("a03_leak_test", "SELECT group_id, count(DISTINCT centre) AS n FROM manifest GROUP BY 1 HAVING count(DISTINCT centre) > 1 OR count(DISTINCT mode) > 4")
def a03(m):
    return m.groupBy("group_id").agg(F.countDistinct("centre").alias("n"), F.countDistinct("mode").alias("k")).where("n > 1 or k > 4").select("group_id", "n")


@_m("a04_count_distinct", "SELECT count(DISTINCT group_id) AS groups, count(DISTINCT file_size) AS sizes FROM manifest")
def a04(m):
    return m.agg(F.countDistinct("group_id").alias("groups"), F.countDistinct("file_size").alias("sizes"))


@_m("a05_size_histogram", "SELECT size, count(*) AS n FROM (SELECT count(*) AS size FROM manifest GROUP BY group_id) GROUP BY size")
def a05(m):
    return L.size_histogram(m, "group_id")


@_m("a06_group_summary", "SELECT centre, round(avg(file_size), 4) AS mean, round(stddev_samp(file_size), 4) AS sd, round(quantile_cont(file_size, 0.5), 4) AS median, min(file_size) AS lo, max(file_size) AS hi FROM manifest GROUP BY centre")
def a06(m):
    return m.groupBy("centre").agg(F.round(F.avg("file_size"), 4).alias("mean"), F.round(F.stddev_samp("file_size"), 4).alias("sd"), F.round(F.percentile("file_size", F.lit(0.5)), 4).alias("median"), F.min("file_size").alias("lo"), F.max("file_size").alias("hi"))


@query("a10_contingency", "SELECT a.lang, b.source, count(d.doc_id) AS n FROM (SELECT DISTINCT lang FROM documents) a CROSS JOIN (SELECT DISTINCT source FROM documents) b LEFT JOIN documents d ON d.lang = a.lang AND d.source = b.source GROUP BY 1, 2")
def a10(s, d):
    return D.contingency(table(s, d, "documents"), "lang", "source")


@query("a11_crosstab_rate", "SELECT lang, count(*) FILTER (toxic = 1) AS pos, count(*) AS n, round_even(100.0::DOUBLE * count(*) FILTER (toxic = 1) / count(*), 2) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a11(s, d):
    j = table(s, d, "documents").join(table(s, d, "labels"), "doc_id")
    return j.groupBy("lang").agg(count_if(F.col("toxic") == 1).alias("pos"), F.count(F.lit(1)).alias("n")).select("lang", "pos", "n", F.bround(100.0 * F.col("pos") / F.col("n"), 2).alias("rate"))


@_m("a12_argmax", "SELECT centre, arg_max(filepath, (file_size, -image_id)) AS largest, arg_min(filepath, (file_size, image_id)) AS smallest FROM manifest GROUP BY centre")
def a12(m):
    return m.groupBy("centre").agg(F.max_by("filepath", F.struct("file_size", -F.col("image_id"))).alias("largest"), F.min_by("filepath", F.struct("file_size", "image_id")).alias("smallest"))


@_m("a13_range_overlap", "SELECT a.mode AS a, b.mode AS b, CASE WHEN greatest(a.lo, b.lo) > least(a.hi, b.hi) THEN 'DISJOINT' ELSE 'OVERLAP' END AS verdict FROM (SELECT mode, min(file_size) AS lo, max(file_size) AS hi FROM manifest GROUP BY 1) a JOIN (SELECT mode, min(file_size) AS lo, max(file_size) AS hi FROM manifest GROUP BY 1) b ON a.mode < b.mode")
def a13(m):
    return L.range_overlap(m, "mode", "file_size")


@query("a14_persistent_set", f"WITH {PRED_SQL}, b AS (SELECT filepath, seed FROM pred WHERE label_int = 1 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY logit, filepath) <= 700) SELECT filepath FROM b GROUP BY filepath HAVING count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM pred)")
def a14(s, d):
    bottom = WN.top_k(pred(s, d).where("label_int = 1"), ["seed"], 700, "logit", "filepath")
    return L.persistent(bottom, "filepath", "seed")


@query("a15_occurrences", f"WITH {PRED_SQL}, b AS (SELECT filepath, seed, row_number() OVER (PARTITION BY seed ORDER BY logit, filepath) AS rank FROM pred WHERE label_int = 1) SELECT filepath, count(*) AS n, round(quantile_cont(rank, 0.5), 6) AS median_rank, round(avg(rank), 6) AS mean_rank FROM b WHERE rank <= 16 GROUP BY filepath")
def a15(s, d):
    b = D.positive_ranks(pred(s, d), ["seed"]).where("in_bottom16")
    return b.groupBy("filepath").agg(F.count(F.lit(1)).alias("n"), r6(F.percentile("rank", F.lit(0.5))).alias("median_rank"), r6(F.avg("rank")).alias("mean_rank"))


@query("a16_fold_contribution", f"WITH {PRED_SQL}, k AS (SELECT *, logit >= 0.5 AS above FROM pred WHERE seed = 0 AND fold >= 0 AND label_int = 0) SELECT fold, round(count(*) FILTER (above)::DOUBLE / sum(count(*) FILTER (above)) OVER () - count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS deviation FROM k GROUP BY fold")
def a16(s, d):
    return L.share_deviation(pred(s, d).where("seed = 0 and fold >= 0 and label_int = 0"), "fold", F.col("logit") >= 0.5).select("fold", r6("deviation").alias("deviation"))


@query("a17_enrichment", f"WITH {PRED_SQL}, t AS (SELECT *, row_number() OVER (ORDER BY logit DESC, filepath) AS rn FROM pred WHERE seed = 0 AND label_int = 0) SELECT centre, count(*) AS all_n, count(*) FILTER (rn <= 50) AS top_n, round((count(*) FILTER (rn <= 50)::DOUBLE / sum(count(*) FILTER (rn <= 50)) OVER ()) / (count(*)::DOUBLE / sum(count(*)) OVER ()), 6) AS ratio FROM t GROUP BY centre")
def a17(s, d):
    return D.enrichment(pred(s, d).where("seed = 0 and label_int = 0"), [], "centre", "logit", "filepath", 50).select("centre", "all_n", "top_n", r6("ratio").alias("ratio"))


@query("a18_latest_record", "SELECT user_id, max(event_id) AS last_event, arg_max(event_type, event_id) AS last_type, arg_min(event_type, event_id) AS first_type FROM events GROUP BY user_id")
def a18(s, d):
    return table(s, d, "events").groupBy("user_id").agg(F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("last_type"), F.min_by("event_type", "event_id").alias("first_type"))


@query("a19_wall_clock", f"WITH {BATCHES_SQL} SELECT batch % 3 AS job, round(sum(seconds) / 3600, 6) AS hours, round(quantile_cont(seconds / 60, 0.5), 6) AS median_minutes, round(avg(seconds / 60), 6) AS mean_minutes FROM batches WHERE batch % 11 <> 0 GROUP BY 1")
def a19(s, d):
    ok = batches(s, d).where("batch % 11 <> 0").withColumn("job", F.col("batch") % 3)
    return ok.groupBy("job").agg(r6(F.sum("seconds") / 3600).alias("hours"), r6(F.percentile(F.col("seconds") / 60, F.lit(0.5))).alias("median_minutes"), r6(F.avg(F.col("seconds") / 60)).alias("mean_minutes"))


@query("a20_first_last_delta", "SELECT user_id, round(arg_max(value, event_id) - arg_min(value, event_id), 6) AS delta, round(avg(value) FILTER (event_id % 10 BETWEEN 4 AND 8), 6) AS mid FROM events GROUP BY user_id")
def a20(s, d):
    return table(s, d, "events").groupBy("user_id").agg(r6(F.max_by("value", "event_id") - F.min_by("value", "event_id")).alias("delta"), r6(F.avg(F.when((F.col("event_id") % 10).between(4, 8), F.col("value")))).alias("mid"))


@query("a21_reason_counter", "SELECT CASE WHEN contains(event_type, 'c') THEN 'has_c' WHEN contains(event_type, 'v') THEN 'has_v' ELSE 'other' END AS reason, count(*) AS n FROM events GROUP BY 1")
def a21(s, d):
    return table(s, d, "events").groupBy(keyword_case(F.col("event_type"), [("c", "has_c"), ("v", "has_v")], "other").alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("a23_quantile_summary", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, min(value) AS lo, round(quantile_cont(value, 0.01), 6) AS q01, round(quantile_cont(value, 0.05), 6) AS q05, round(avg(CASE WHEN value < 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS below FROM events")
def a23(s, d):
    return L.quantile_summary(table(s, d, "events"), "value", 10)


@_m("a24_pairwise_agreement", "SELECT round(avg(CASE WHEN a.f = b.f THEN 1.0::DOUBLE ELSE 0 END), 6) AS agreement FROM (UNPIVOT (SELECT image_id, fold_r0, fold_r1, fold_r2, fold_r3 FROM manifest) ON fold_r0, fold_r1, fold_r2, fold_r3 INTO NAME r VALUE f) a JOIN (UNPIVOT (SELECT image_id, fold_r0, fold_r1, fold_r2, fold_r3 FROM manifest) ON fold_r0, fold_r1, fold_r2, fold_r3 INTO NAME r VALUE f) b ON a.image_id = b.image_id AND a.r < b.r")
def a24(m):
    return L.pairwise_agreement(m, [f"fold_r{i}" for i in range(4)])


@_m("a25_pinned_rows", "SELECT count(*) AS pinned FROM manifest WHERE fold_r0 = fold_r1 AND fold_r1 = fold_r2 AND fold_r2 = fold_r3")
def a25(m):
    return m.where(F.size(F.array_distinct(F.array(*[f"fold_r{i}" for i in range(4)]))) == 1).agg(F.count(F.lit(1)).alias("pinned"))


@_m("a26_stratum_percent", "SELECT centre, class_label, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS pct FROM manifest GROUP BY 1, 2")
def a26(m):
    return L.frequencies(m, "centre", "class_label").select("centre", "class_label", r6(F.col("share") * 100).alias("pct"))


@query("a27_corpus_reference", "SELECT round(avg(m), 6) AS mean, round(avg(sd), 6) AS sd FROM (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id)")
def a27(s, d):
    each = table(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).groupBy("vec_id").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return each.agg(r6(F.avg("m")).alias("mean"), r6(F.avg("sd")).alias("sd"))


@query("a29_completion", f"WITH {PRED_SQL}, g AS (SELECT s AS seed, f AS fold FROM (SELECT unnest(range(7)) AS s), (SELECT unnest(range(5)) AS f)) SELECT count(*) AS total, count(d.seed) AS done, count(*) - count(d.seed) AS missing FROM g LEFT JOIN (SELECT DISTINCT seed, fold FROM pred) d ON g.seed = d.seed AND g.fold = d.fold")
def a29(s, d):
    grid = L.unit_grid(s, repeats=1, seeds=7, folds=5).select("seed", "fold")
    done = pred(s, d).select("seed", "fold").distinct().withColumn("ok", F.lit(1))
    return grid.join(done, ["seed", "fold"], "left").agg(F.count(F.lit(1)).alias("total"), F.count("ok").alias("done"), (F.count(F.lit(1)) - F.count("ok")).alias("missing"))


@query("a30_bucket_mean", "SELECT CAST(floor(event_id / 100) AS BIGINT) AS bucket, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def a30(s, d):
    return table(s, d, "events").groupBy(F.floor(F.col("event_id") / 100).cast("long").alias("bucket")).agg(r6(F.avg("value")).alias("mean"))


@query("a31_variation", "SELECT event_type, round(stddev_pop(value) / greatest(avg(value), 1), 6) AS cv FROM events GROUP BY event_type")
def a31(s, d):
    return table(s, d, "events").groupBy("event_type").agg(r6(F.stddev_pop("value") / F.greatest(F.avg("value"), F.lit(1.0))).alias("cv"))


# ---- windows over batches, order, limits, sets


@query("w06_group_median", "SELECT e.event_id, m AS group_median FROM events e JOIN (SELECT event_type, round(quantile_cont(value, 0.5), 6) AS m FROM events GROUP BY 1) g ON e.event_type = g.event_type")
def w06(s, d):
    return WN.with_group(table(s, d, "events"), ["event_type"], group_median=r6(F.percentile("value", F.lit(0.5)))).select("event_id", "group_median")


@query("w10_group_numbers", f"WITH {DUPS_SQL} SELECT doc_id, dense_rank() OVER (ORDER BY sha256_hash) AS number FROM dups")
def w10(s, d):
    return L.numbered_groups(dups(s, d), "sha256_hash").select("doc_id", "number")


@query("w11_keep_first", f"WITH {DUPS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY sha256_hash ORDER BY filepath) = 1 AS keep FROM dups")
def w11(s, d):
    x = dups(s, d)
    return WN.with_group(x, ["sha256_hash"], first=F.min("filepath")).select("doc_id", (F.col("filepath") == F.col("first")).alias("keep"))


@query("w12_trailing_rate", f"WITH {BATCHES_SQL} SELECT batch, round(sum(n_items) OVER (ORDER BY batch ROWS 3 PRECEDING) / sum(seconds) OVER (ORDER BY batch ROWS 3 PRECEDING), 6) AS rate FROM batches")
def w12(s, d):
    b = batches(s, d).withColumn("run", F.lit(0))
    return b.select("batch", r6(WN.trailing_rate(b, ["run"], "batch", "n_items", "seconds", 4)).alias("rate"))


@query("w13_difference", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS step FROM events")
def w13(s, d):
    return table(s, d, "events").select("event_id", r6(F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("event_id"))).alias("step"))


_GRID = "g AS (SELECT s AS k, x, pow(x - s, 3) + x AS y FROM (SELECT unnest(range(4)) AS s), (SELECT unnest(range(8)) / 1.0::DOUBLE AS x))"


def _grid(s):
    return s.range(4).withColumnRenamed("id", "k").withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("x", F.col("x").cast("double")).withColumn("y", F.pow(F.col("x") - F.col("k"), 3) + F.col("x"))


@query("w14_crossing", f"WITH {_GRID}, p AS (SELECT k, x, y, lead(x) OVER (PARTITION BY k ORDER BY x) AS x1, lead(y) OVER (PARTITION BY k ORDER BY x) AS y1 FROM g) SELECT k, round(coalesce(min(x) FILTER (y = 5), arg_min(x + (5 - y) * (x1 - x) / (y1 - y), x) FILTER ((y - 5) * (y1 - 5) < 0)), 6) AS x FROM p GROUP BY k")
def w14(s, d):
    return WN.crossing(_grid(s), ["k"], "x", "y", 5.0).select("k", r6("x").alias("x"))


@query("w15_point_interpolation", f"WITH {_GRID}, p AS (SELECT k, x, y, lead(x) OVER (PARTITION BY k ORDER BY x) AS x1, lead(y) OVER (PARTITION BY k ORDER BY x) AS y1 FROM g) SELECT k, round(y + (2.5 - x) * (y1 - y) / (x1 - x), 6) AS y FROM p WHERE x <= 2.5 AND x1 > 2.5")
def w15(s, d):
    return WN.interpolate(_grid(s), ["k"], "x", "y", 2.5).select("k", r6("y").alias("y"))


@query("o01_sort", f"WITH {MANIFEST_SQL} SELECT filepath, row_number() OVER (PARTITION BY centre ORDER BY file_size DESC, filepath) AS rn FROM manifest")
def o01(s, d):
    return WN.numbered(manifest(s, d), ["centre"], "-file_size", "filepath").select("filepath", F.col("rn").cast("long").alias("rn"))


@query("o02_top_n", f"WITH {PRED_SQL} SELECT filepath, round(logit, 6) AS logit FROM pred WHERE seed = 0 ORDER BY pred.logit DESC, filepath LIMIT 50")
def o02(s, d):
    return pred(s, d).where("seed = 0").orderBy(F.desc("logit"), "filepath").limit(50).select("filepath", r6("logit").alias("logit"))


@query("o03_multi_key", f"WITH {MANIFEST_SQL} SELECT group_id, rank() OVER (ORDER BY greatest(a, b), n DESC, group_id) AS place FROM (SELECT group_id, avg(fold_r1) AS a, avg(fold_r2) AS b, count(*) AS n FROM manifest GROUP BY 1)")
def o03w(s, d):
    g = manifest(s, d).groupBy("group_id").agg(F.avg("fold_r1").alias("a"), F.avg("fold_r2").alias("b"), F.count(F.lit(1)).alias("n"))
    return WN.placed(g.select("group_id", "n", F.greatest("a", "b").alias("worst")), "worst", "n", "group_id").select("group_id", "place")


@query("o04_pages", f"WITH {MANIFEST_SQL} SELECT centre, CAST(floor((row_number() OVER (PARTITION BY centre ORDER BY filepath) - 1) / 16) AS BIGINT) AS page, filepath FROM manifest WHERE label_int = 1")
def o04(s, d):
    return WN.numbered(manifest(s, d).where("label_int = 1"), ["centre"], "filepath").select("centre", F.floor((F.col("rn") - 1) / 16).cast("long").alias("page"), "filepath")


@_m("o05_set_equality", "SELECT (SELECT count(*) FROM (SELECT filepath FROM manifest WHERE fold_r0 = 0 EXCEPT SELECT filepath FROM manifest WHERE fold_r1 = 0)) AS missing, (SELECT count(*) FROM (SELECT filepath FROM manifest WHERE fold_r1 = 0 EXCEPT SELECT filepath FROM manifest WHERE fold_r0 = 0)) AS unexpected")
def o05(m):
    return L.coverage(m.where("fold_r0 = 0"), m.where("fold_r1 = 0"), ["filepath"])


@query("o06_union_all", f"WITH {PRED_SQL} SELECT centre, count(*) AS n FROM (SELECT * FROM pred WHERE seed = 0 UNION ALL SELECT * FROM pred WHERE seed = 1) GROUP BY 1")
def o06(s, d):
    p = pred(s, d)
    return p.where("seed = 0").unionByName(p.where("seed = 1")).groupBy("centre").agg(F.count(F.lit(1)).alias("n"))


@_m("o07_intersection", "SELECT group_id FROM manifest WHERE fold_r0 IN (1, 2) INTERSECT SELECT group_id FROM manifest WHERE fold_r2 IN (1, 3)")
def o07(m):
    return m.where("fold_r0 in (1, 2)").select("group_id").intersect(m.where("fold_r2 in (1, 3)").select("group_id"))


@_m("o08_difference", "SELECT DISTINCT filepath FROM manifest WHERE image_id NOT IN (SELECT image_id FROM manifest WHERE image_id % 3 = 0)")
def o08(m):
    return m.join(m.where("image_id % 3 = 0").select("image_id"), "image_id", "left_anti").select("filepath").distinct()


@query("o09_combinations", "SELECT m AS subset, bit_count(m) AS k FROM (SELECT unnest(range(1, 32)) AS m) WHERE bit_count(m) = 3")
def o09(s, d):
    return L.subsets(s, 5).where("k = 3")


@query("o10_leave_one_out", f"WITH {PRED_SQL} SELECT d AS dropped, count(*) AS n, round(avg(logit), 6) AS mean FROM pred, (SELECT unnest(range(5)) AS d) WHERE seed <> d GROUP BY 1")
def o10(s, d):
    return L.leave_one_out(pred(s, d), "seed", 5).groupBy("dropped").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("logit")).alias("mean"))


@_m("o11_middle_row", "SELECT centre, filepath FROM (SELECT centre, filepath, row_number() OVER (PARTITION BY centre ORDER BY file_size, filepath) AS rn, count(*) OVER (PARTITION BY centre) AS n FROM manifest) WHERE rn = n // 2 + 1")
def o11(m):
    return L.middle_row(m, ["centre"], "file_size", "filepath").select("centre", "filepath")


@query("b05_uniform_sample", f"SELECT doc_id FROM documents ORDER BY {_HASH.format(chr(39) + '11|' + chr(39) + ' || CAST(doc_id AS VARCHAR)')}, doc_id LIMIT 40")
def b05(s, d):
    return table(s, d, "documents").orderBy(draw(11, F.col("doc_id")), "doc_id").limit(40).select("doc_id")
