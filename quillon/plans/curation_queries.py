"""Duplicates, folds, constraints, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import count_if, r6
from ..operators import curation as C
from ..operators import relational as L
from .bindings import CODES_SQL, DUPS_SQL, MANIFEST_SQL, PRED_SQL, codes, dups, manifest, pred, table
from .registry import query

_X = "CAST(bit_count(xor(a.code, b.code)) AS BIGINT)"


@query("g01_duplicate_audit", f"WITH {DUPS_SQL}, g AS (SELECT sha256_hash AS h, count(*) AS size, count(DISTINCT class_label) > 1 AS is_cross_class, dense_rank() OVER (ORDER BY sha256_hash) AS number FROM dups GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, size, number, is_cross_class FROM dups JOIN g ON sha256_hash = h")
def g01(s, d):
    return C.audit_duplicates(dups(s, d)).select("doc_id", "size", "number", "is_cross_class")


@query("g02_keep_for_training", f"WITH {DUPS_SQL} SELECT doc_id, filepath = min(filepath) OVER (PARTITION BY sha256_hash) AS keep_for_training FROM dups")
def g02(s, d):
    return C.resolve_duplicates(dups(s, d)).select("doc_id", "keep_for_training")


def _ids(s, d):
    return codes(s, d).select(F.col("vec_id").alias("id"), "label", "code", "dcode")


@query("g03_hamming", f"WITH {CODES_SQL} SELECT a.vec_id AS a, b.vec_id AS b, {_X} AS distance FROM codes a JOIN codes b ON b.vec_id = a.vec_id + 1")
def g03(s, d):
    from ..functions.scalar import hamming

    c = _ids(s, d)
    return c.join(c.select((F.col("id") - 1).alias("id"), F.col("code").alias("other")), "id").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), hamming(F.col("code"), F.col("other")).cast("long").alias("distance"))


@query("j08_hamming_self_join", f"WITH {CODES_SQL} SELECT a.vec_id AS a, b.vec_id AS b, {_X} AS distance FROM codes a JOIN codes b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 12")
def j08(s, d):
    c = _ids(s, d)
    return C.hamming_pairs(c, c, 12).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("j09_hamming_cross_join", f"WITH {CODES_SQL} SELECT a.vec_id AS a, b.vec_id AS b, {_X} AS distance FROM codes a JOIN codes b ON a.label < 5 AND b.label >= 5 WHERE bit_count(xor(a.code, b.code)) <= 14")
def j09(s, d):
    c = _ids(s, d)
    return C.hamming_pairs(c.where("label < 5"), c.where("label >= 5"), 14, self_join=False).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("a22_pairs_by_threshold", f"WITH {CODES_SQL}, p AS (SELECT a.label AS la, b.label AS lb, a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.code, b.code)) AS d FROM codes a JOIN codes b ON a.vec_id < b.vec_id WHERE bit_count(xor(a.code, b.code)) <= 12), t AS (SELECT unnest([8, 10, 12]) AS t) SELECT CAST(t AS BIGINT) AS threshold, la, lb, count(*) AS pairs, count(DISTINCT a) AS distinct_a FROM p, t WHERE d <= t GROUP BY 1, 2, 3")
def a22(s, d):
    c = _ids(s, d)
    lab = c.select("id", "label")
    p = C.hamming_pairs(c, c, 12).join(lab.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(lab.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
    t = p.withColumn("threshold", F.explode(F.array(*[F.lit(x).cast("long") for x in (8, 10, 12)]))).where("distance <= threshold")
    return t.groupBy("threshold", "la", "lb").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("a").alias("distinct_a"))


_CC = """e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM codes a JOIN codes b ON a.vec_id <> b.vec_id WHERE bit_count(xor(a.code, b.code)) <= {t}),
r(n, m) AS (SELECT vec_id, vec_id FROM codes UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n WHERE r.m < e.b)"""


_OR = lambda a, b: f"(bit_count(xor({a}.code, {b}.code)) <= 8 OR bit_count(xor({a}.dcode, {b}.dcode)) <= 6)"


@query("j08_either_hash", f"WITH {CODES_SQL} SELECT a.vec_id AS a, b.vec_id AS b, CAST(bit_count(xor(a.code, b.code)) AS BIGINT) AS code_distance, CAST(bit_count(xor(a.dcode, b.dcode)) AS BIGINT) AS dcode_distance FROM codes a JOIN codes b ON a.vec_id < b.vec_id WHERE {_OR('a', 'b')}")
def j08e(s, d):
    """Pairs within the threshold of either of two codes."""
    c = _ids(s, d)
    return C.either_pairs(c, c, {"code": 8, "dcode": 6})


@query("g04_hamming_clusters", f"WITH RECURSIVE {CODES_SQL}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM codes a JOIN codes b ON a.vec_id <> b.vec_id WHERE {_OR('a', 'b')}), r(n, m) AS (SELECT vec_id, vec_id FROM codes UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n WHERE r.m < e.b) SELECT n AS id, min(m) AS label FROM r GROUP BY n")
def g04(s, d):
    c = _ids(s, d)
    return C.connected_components(c, C.either_pairs(c, c, {"code": 8, "dcode": 6}).select("a", "b"))


_KNN = f"""k AS (SELECT a.vec_id AS i, b.vec_id AS j, {_X} AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY bit_count(xor(a.code, b.code)), b.vec_id) AS rank FROM codes a JOIN codes b ON a.vec_id <> b.vec_id)"""


@query("w16_nearest", f"WITH {CODES_SQL}, {_KNN} SELECT i, j, distance, rank FROM k WHERE rank <= 5")
def w16(s, d):
    return C.nearest(_ids(s, d), 5).select("i", "j", F.col("distance").cast("long").alias("distance"), "rank")


@query("g05_mutual_knn", f"WITH {CODES_SQL}, {_KNN}, n AS (SELECT i, j FROM k WHERE rank <= 5 AND distance <= 20) SELECT x.i AS a, x.j AS b FROM n x JOIN n y ON x.i = y.j AND x.j = y.i WHERE x.i < x.j")
def g05(s, d):
    return C.mutual_edges(C.nearest(_ids(s, d), 5), 20)


@query("g06_components", f"WITH RECURSIVE {CODES_SQL}, {_CC.format(t=12)} SELECT n AS id, min(m) AS label FROM r GROUP BY n")
def g06(s, d):
    c = _ids(s, d)
    return C.connected_components(c, C.hamming_pairs(c, c, 12).select("a", "b"))


_SENSE = lambda t: f"""r{t}(n, m) AS (SELECT vec_id, vec_id FROM codes UNION SELECT e.b, r{t}.m FROM r{t} JOIN (SELECT a.vec_id AS a, b.vec_id AS b FROM codes a JOIN codes b ON a.vec_id <> b.vec_id AND bit_count(xor(a.code, b.code)) <= {t}) e ON e.a = r{t}.n WHERE r{t}.m < e.b),
s{t} AS (SELECT label, count(*) AS n FROM (SELECT n, min(m) AS label FROM r{t} GROUP BY n) GROUP BY label)"""  # noqa: E731


@query("g07_sensitivity", f"WITH RECURSIVE {CODES_SQL}, {', '.join(_SENSE(t) for t in (6, 9, 12))} " + " UNION ALL ".join(f"SELECT CAST({t} AS BIGINT) AS threshold, count(*) AS clusters, CAST(max(n) AS BIGINT) AS largest, round(100.0 * max(n) / sum(n), 6) AS largest_pct FROM s{t}" for t in (6, 9, 12)))
def g07(s, d):
    c = _ids(s, d)
    return C.sensitivity(c, C.hamming_pairs(c, c, 12), [6, 9, 12]).select("threshold", "clusters", "largest", r6("largest_pct").alias("largest_pct"))


@query("g08_degenerate_guard", "SELECT max(n) <= 0.2 * sum(n) AS ok, CAST(max(n) AS BIGINT) AS largest FROM (SELECT count(*) AS n FROM embeddings GROUP BY label)")
def g08(s, d):
    n = table(s, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return n.agg((F.max("n") <= 0.2 * F.sum("n")).alias("ok"), F.max("n").alias("largest"))


@query("g09_mixed_groups", f"WITH {DUPS_SQL} SELECT sha256_hash, count(*) AS n, count(DISTINCT class_label) AS classes, count(DISTINCT centre) AS centres FROM dups GROUP BY 1 HAVING count(DISTINCT class_label) > 1 OR count(DISTINCT centre) > 1")
def g09(s, d):
    return C.inspect_groups(dups(s, d), "sha256_hash")


@query("g10_group_split", f"WITH {MANIFEST_SQL} SELECT concat_ws('_', CAST(group_id % 10 AS VARCHAR), centre) AS group_id_v2, count(*) AS n, count(DISTINCT centre) AS centres FROM manifest GROUP BY 1")
def g10(s, d):
    m = manifest(s, d).withColumn("group_id_v2", F.concat_ws("_", (F.col("group_id") % 10).cast("string"), "centre"))
    return m.groupBy("group_id_v2").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("centre").alias("centres"))


@query("g11_overlap_report", f"WITH {CODES_SQL}, p AS (SELECT bit_count(xor(a.code, b.code)) AS d FROM codes a JOIN codes b ON a.label < 5 AND b.label >= 5) SELECT CASE WHEN d = 0 THEN 'exact' WHEN d <= 8 THEN 'near' ELSE 'far' END AS band, count(*) AS n FROM p WHERE d <= 14 GROUP BY 1")
def g11(s, d):
    c = _ids(s, d)
    p = C.hamming_pairs(c.where("label < 5"), c.where("label >= 5"), 14, self_join=False)
    return p.groupBy(F.when(F.col("distance") == 0, "exact").when(F.col("distance") <= 8, "near").otherwise("far").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("g13_group_leakage", f"WITH {PRED_SQL}, x AS (SELECT *, image_id % 7919 AS g FROM pred WHERE seed = 0 AND fold >= 0) SELECT v.fold, count(*) AS n, round(avg(v.logit), 6) AS mean FROM x v WHERE NOT EXISTS (SELECT 1 FROM x t WHERE t.g = v.g AND t.fold <> v.fold AND t.image_id % 2 = 0) GROUP BY v.fold")
def g13(s, d):
    x = pred(s, d).where("seed = 0 and fold >= 0").withColumn("g", F.col("image_id") % 7919)
    other = x.where("image_id % 2 = 0").select("g", F.col("fold").alias("f")).distinct().withColumn("fold", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda k: k != F.col("f"))))
    return L.without_leaks(x, other, ["g", "fold"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("logit")).alias("mean"))


@query("g15_group_folds")
def g15(s, d):
    return C.group_folds(manifest(s, d), 3, 5)


@query("g14_group_folds_verified")
def g14(s, d):
    m = manifest(s, d).select("group_id", "label_int")
    f = C.group_folds(m, 1, 5).select("group_id", "fold")
    return C.verify_folds(m.join(f, "group_id"), "fold")


@query("g16_fold_checks", f"WITH {MANIFEST_SQL}, k AS (SELECT * FROM manifest WHERE fold_r0 <> -1) SELECT 'leaks' AS \"check\", (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY group_id HAVING count(DISTINCT fold_r0) > 1))::DOUBLE AS value, (SELECT count(*) FROM (SELECT 1 FROM k GROUP BY group_id HAVING count(DISTINCT fold_r0) > 1)) = 0 AS holds UNION ALL SELECT 'positives', (max(p) - min(p))::DOUBLE, max(p) - min(p) <= 2 FROM (SELECT sum(label_int) AS p FROM k GROUP BY fold_r0) UNION ALL SELECT 'totals', round((max(n) - min(n)) / avg(n), 6), (max(n) - min(n)) / avg(n) <= 0.05 FROM (SELECT count(*) AS n FROM k GROUP BY fold_r0)")
def g16(s, d):
    return C.verify_folds(manifest(s, d), "fold_r0").select("check", r6("value").alias("value"), "holds")


@query("g17_holdout_columns", f"WITH {MANIFEST_SQL} SELECT filepath, CASE WHEN centre = 'center_1' THEN 'test' ELSE 'train' END AS holdout_center_1, CASE WHEN centre = 'center_2' THEN 'test' ELSE 'train' END AS holdout_center_2 FROM manifest")
def g17(s, d):
    return manifest(s, d).select("filepath", *[F.when(F.col("centre") == f"center_{k}", "test").otherwise("train").alias(f"holdout_center_{k}") for k in (1, 2)])


# ---- constraints


@query("v01_unique_key", f"WITH {PRED_SQL} SELECT count(*) AS violations FROM (SELECT 1 FROM pred GROUP BY filepath, seed HAVING count(*) > 1)")
def v01(s, d):
    return C.unique_key(pred(s, d), ["filepath", "seed"])


@query("v02_exact_coverage", f"WITH {PRED_SQL} SELECT count(*) FILTER (p.filepath IS NULL) AS missing, count(*) FILTER (m.filepath IS NULL) AS unexpected FROM (SELECT filepath FROM manifest WHERE keep_for_training) m FULL JOIN (SELECT DISTINCT filepath FROM pred WHERE fold >= 0 AND image_id % 100 <> 7) p ON p.filepath = m.filepath")
def v02(s, d):
    return L.coverage(manifest(s, d).where("keep_for_training"), pred(s, d).where("fold >= 0 and image_id % 100 <> 7"), ["filepath"])


@query("v03_single_seed", f"WITH {PRED_SQL} SELECT count(DISTINCT seed) - 1 AS violations FROM pred WHERE seed = 2")
def v03(s, d):
    return C.single_value(pred(s, d).where("seed = 2"), "seed")


@query("v04_dump_validation", f"WITH {PRED_SQL}, u AS (SELECT seed, fold, count(*) AS n, count(DISTINCT filepath) AS ids, sum(label_int) AS p, count(DISTINCT logit) AS v FROM pred GROUP BY 1, 2), q AS (SELECT seed, fold, CASE WHEN n < 200 THEN 'rows' WHEN ids < n THEN 'duplicates' WHEN p = 0 THEN 'class balance' WHEN v < 2 THEN 'degenerate' ELSE 'ok' END AS reason FROM u) SELECT seed, fold, reason = 'ok' AS ok, reason FROM q")
def v04(s, d):
    return C.validate_dump(pred(s, d), ["seed", "fold"], 200)


@query("v06_null_pattern", f"WITH {MANIFEST_SQL} SELECT count(*) FILTER (filepath IS NULL) AS filepath, count(*) FILTER ((visibility IS NULL) <> (label_int = 0)) AS visibility FROM manifest")
def v06(s, d):
    return C.null_pattern(manifest(s, d), ["filepath"], {"visibility": F.col("label_int") == 0})


@query("v07_expected_counts", f"WITH {MANIFEST_SQL} SELECT count(*) AS n, count(*) FILTER (keep_for_training) AS kept, count(DISTINCT group_id) AS groups FROM manifest")
def v07(s, d):
    return manifest(s, d).agg(F.count(F.lit(1)).alias("n"), count_if(F.col("keep_for_training")).alias("kept"), F.countDistinct("group_id").alias("groups"))


@query("v08_sentinel_invariant", f"WITH {MANIFEST_SQL} SELECT count(*) FILTER (NOT keep_for_training AND fold_r0 <> -1) AS violations FROM manifest")
def v08(s, d):
    return manifest(s, d).agg(count_if(~F.col("keep_for_training") & (F.col("fold_r0") != -1)).alias("violations"))


@query("v09_distinct_scores", f"WITH {PRED_SQL} SELECT count(DISTINCT logit) AS scores, count(DISTINCT filepath) AS inputs, count(DISTINCT logit) > 0.99 * count(DISTINCT filepath) AS ok FROM pred WHERE seed = 0")
def v09(s, d):
    return C.distinct_scores(pred(s, d).where("seed = 0"), "logit", "filepath")


@query("v10_duplicates_confined", f"WITH {DUPS_SQL} SELECT count(*) AS violations FROM (SELECT 1 FROM dups GROUP BY sha256_hash HAVING count(DISTINCT class_label) > 1)")
def v10(s, d):
    return dups(s, d).groupBy("sha256_hash").agg(F.countDistinct("class_label").alias("k")).agg(count_if(F.col("k") > 1).alias("violations"))


# ---- sources and sinks


@query("s03_schema_checked_scan", f"WITH {PRED_SQL} SELECT seed, count(*) AS n, round(sum(logit), 4) AS total FROM pred GROUP BY seed")
def s03(s, d):
    from ..sources.predictions import read_predictions, temporary_folder, write_predictions

    folder = temporary_folder(s)
    write_predictions(pred(s, d).withColumnRenamed("group_id", "group_id_v2"), folder)
    return read_predictions(s, folder).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("logit"), 4).alias("total"))


@query("s05_multi_unit_scan", f"WITH {PRED_SQL} SELECT fold, count(*) AS n FROM pred WHERE seed = 3 AND fold IN (0, 2, 4) GROUP BY fold")
def s05(s, d):
    from ..sources.predictions import load_units, temporary_folder, write_predictions

    folder = temporary_folder(s)
    write_predictions(pred(s, d).withColumnRenamed("group_id", "group_id_v2"), folder)
    return load_units(s, folder, repeat=0, seed=3, folds=[0, 2, 4]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query("s08_path_parse", "SELECT page_id, string_split(url, '/')[3] AS host, CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' ELSE 'unknown' END AS section FROM pages")
def s08(s, d):
    from ..functions.scalar import keyword_case

    return table(s, d, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("host"), keyword_case(F.col("url"), [("/en/", "english"), ("/de/", "german")], "unknown").alias("section"))


@query("s09_filename_regex", "SELECT page_id, CAST(nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), '') AS BIGINT) AS item, coalesce(nullif(regexp_extract(url, '//([a-z]+)', 1), ''), 'unknown') AS name FROM pages")
def s09(s, d):
    part = lambda p: F.nullif(F.regexp_extract("url", p, 1), F.lit(""))
    return table(s, d, "pages").select("page_id", part("/([0-9]+)(?:[?#]|$)").cast("long").alias("item"), F.coalesce(part("//([a-z]+)"), F.lit("unknown")).alias("name"))


@query("s14_event_log", "SELECT user_id, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS highest, arg_max(CAST(json_extract(props, '$.k') AS BIGINT), event_id) AS latest FROM events GROUP BY user_id")
def s14(s, d):
    k = F.from_json("props", "k long")["k"]
    return table(s, d, "events").withColumn("k", k).groupBy("user_id").agg(F.max("k").alias("highest"), F.max_by("k", "event_id").alias("latest"))


@query("s16_array_files", "SELECT vec_id, CAST(i AS BIGINT) AS pos, embedding[i + 1] AS x FROM (SELECT vec_id, embedding, unnest(range(len(embedding))) AS i FROM embeddings)")
def s16w(s, d):
    return table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), "x")


@query("k05_ordered_list", "SELECT user_id, list(value ORDER BY event_id) AS scores FROM events GROUP BY user_id")
def k05w(s, d):
    rows = F.array_sort(F.collect_list(F.struct("event_id", "value")))
    return table(s, d, "events").groupBy("user_id").agg(F.transform(rows, lambda x: x["value"]).alias("scores"))


@query("k08_text_histogram", "SELECT lang, repeat('#', CAST(floor(40.0 * count(*) / max(count(*)) OVER ()) AS INTEGER)) AS bar FROM documents GROUP BY lang")
def k08(s, d):
    n = table(s, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    top = n.agg(F.max("n").alias("top"))
    return n.crossJoin(F.broadcast(top)).select("lang", F.expr("repeat('#', cast(floor(40.0D * n / top) as int))").alias("bar"))  # one row


@query("k10_upsert", "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def k10(s, d):
    from ..sources.sinks import latest_wins

    return latest_wins(table(s, d, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


@query("k11_content_registry", f"WITH {DUPS_SQL} SELECT centre, sha256(string_agg(sha256_hash, '' ORDER BY sha256_hash)) AS digest FROM dups GROUP BY centre")
def k11(s, d):
    return dups(s, d).groupBy("centre").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("sha256_hash")), ""), 256).alias("digest"))
