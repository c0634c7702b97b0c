"""Small models over table features: mixtures, cross-validated regression, forests and clustering."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import finite


def bimodality(df: DataFrame, value: str, *, cells: int = 4096) -> DataFrame:
    """Whether a column's values have two modes: BIC of one and of two normal components, and Ashman's D.

    Bimodal if the BIC of one exceeds that of two by more than 10 and D is above 2 (no dip test is at hand). The values
    are first reduced to the counts and means of `cells` equal-width cells, so the mixture is fitted in one small task;
    it starts from the halves around the mean. A constant column is not bimodal.
    """
    rows = df.where(finite(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v"))
    span = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cell = F.least(F.floor(F.coalesce(F.try_divide((F.col("v") - F.col("lo")) * cells, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(cells - 1))
    binned = rows.crossJoin(F.broadcast(span)).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("v"), F.var_pop("v").alias("var"))  # one row

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cell")
        n, v, var = (pdf[c].to_numpy(float) for c in ("n", "v", "var"))
        total = n.sum()
        mean = (n * v).sum() / total
        spread = (n * (var + (v - mean) ** 2)).sum() / total
        floor = max(1e-6, spread * 1e-6)
        log_normal = lambda m, s: -0.5 * (np.log(2 * np.pi * s) + ((v - m) ** 2 + var) / s)
        one = (n * log_normal(mean, max(spread, floor))).sum()
        high = v > mean
        if not high.any() or high.all():
            return pd.DataFrame([(int(total), None, None, None, None, None, False)], columns=names)
        part = np.stack([~high, high]).astype(float)
        last = -math.inf
        for _ in range(1000):
            weight = (part * n).sum(1)
            m = (part * n * v).sum(1) / weight
            s = np.maximum((part * n * (var + (v - m[:, None]) ** 2)).sum(1) / weight, floor)
            joint = np.log(weight / total)[:, None] + np.stack([log_normal(*p) for p in zip(m, s, strict=True)])
            top = joint.max(0)
            each = top + np.log(np.exp(joint - top).sum(0))
            part = np.exp(joint - each)
            now = (n * each).sum()
            if now - last < 1e-9 * abs(now):
                break
            last = now
        bic1, bic2 = 2 * math.log(total) - 2 * one, 5 * math.log(total) - 2 * now
        d = abs(m[0] - m[1]) * math.sqrt(2) / math.sqrt(s.sum())
        return pd.DataFrame([(int(total), bic1, bic2, d, m.tolist(), np.sqrt(s).tolist(), bool(bic1 - bic2 > 10 and d > 2))], columns=names)

    names = ["n", "bic_1", "bic_2", "ashmans_d", "means", "sds", "bimodal"]
    return binned.groupBy().applyInPandas(fit, "n long, bic_1 double, bic_2 double, ashmans_d double, means array<double>, sds array<double>, bimodal boolean")


def cross_validated_logistic(df: DataFrame, features: list[str], label: str, fold: str, *, c: float = 1.0, rounds: int = 25) -> DataFrame:
    """df with `score`, the logit of a row under the model of the other folds; folds of one class are left out.

    Features are standardised on each fold's training rows. Each model minimises |w|^2 / 2 + c * the log loss (no penalty
    on the intercept) by Newton's steps; gradients and Hessians of all folds come from one partial aggregation a step,
    and the driver holds one small matrix a fold.
    """
    folds = sorted(r[0] for r in df.where(F.col(fold).isNotNull()).select(fold).distinct().collect())
    d = len(features)
    x = [F.col(f).cast("double") for f in features]
    moments = df.groupBy(fold).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("p"), *[F.sum(v).alias(f"s{i}") for i, v in enumerate(x)], *[F.sum(v * v).alias(f"q{i}") for i, v in enumerate(x)]).collect()
    whole = {k: np.array([float(r[k] or 0) for r in moments]) for k in (["n", "p"] + [f"{m}{i}" for m in "sq" for i in range(d)])}
    at = {r[fold]: i for i, r in enumerate(moments)}
    models = {}
    for k in folds:
        rest = {m: v.sum() - v[at[k]] for m, v in whole.items()}
        both = 0 < rest["p"] < rest["n"] and 0 < whole["p"][at[k]] < whole["n"][at[k]]
        if both:
            mean = np.array([rest[f"s{i}"] / rest["n"] for i in range(d)])
            sd = np.sqrt(np.maximum(np.array([rest[f"q{i}"] / rest["n"] for i in range(d)]) - mean**2, 0))
            models[k] = {"mean": mean, "sd": np.where(sd > 0, sd, 1.0), "w": np.zeros(d + 1)}
    if not models:
        return df.where("false").withColumn("score", F.lit(0.0))

    def scaled(m: dict) -> list:
        return [F.lit(1.0), *[(v - float(a)) / float(b) for v, a, b in zip(x, m["mean"], m["sd"], strict=True)]]

    def logit(m: dict):
        return sum((v * float(w) for v, w in zip(scaled(m), m["w"], strict=True)), F.lit(0.0))

    for _ in range(rounds):
        sums = []
        for k, m in models.items():
            z, p = scaled(m), 1 / (1 + F.exp(-logit(m)))
            train = (F.col(fold) != F.lit(k)).cast("double")
            sums += [F.sum(train * (p - F.col(label)) * v).alias(f"g_{at[k]}_{i}") for i, v in enumerate(z)]
            sums += [F.sum(train * p * (1 - p) * z[i] * z[j]).alias(f"h_{at[k]}_{i}_{j}") for i in range(d + 1) for j in range(i, d + 1)]
        row, step = df.agg(*sums).first(), 0.0
        for k, m in models.items():
            penalty = np.r_[0.0, np.ones(d)]
            g = c * np.array([row[f"g_{at[k]}_{i}"] for i in range(d + 1)]) + penalty * m["w"]
            h = np.array([[row[f"h_{at[k]}_{min(i, j)}_{max(i, j)}"] for j in range(d + 1)] for i in range(d + 1)]) * c + np.diag(penalty)
            move = np.linalg.lstsq(h, g, rcond=None)[0]
            m["w"] = m["w"] - move
            step = max(step, float(np.abs(move).max()))
        if step < 1e-10:
            break
    score = F.lit(None).cast("double")
    for k, m in models.items():
        score = F.when(F.col(fold) == F.lit(k), logit(m)).otherwise(score)
    return df.where(F.col(fold).isin(list(models))).withColumn("score", score)


def forest_scores(df: DataFrame, features: list[str], label: str, fold: str, *, trees: int = 300, depth: int = 5, seed: int = 0) -> tuple[DataFrame, list[tuple[str, float]]]:
    """df with `score`, a random forest's probability out of fold, and the importances of a forest of all rows.

    Classes weigh the same in total. Folds are few; each is one distributed fit.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("size__"))
    total, classes = (n.agg(F.sum("size__"), F.count(F.lit(1))).first())[0:2]
    balanced = df.join(F.broadcast(n), label).withColumn("weight__", F.lit(float(total)) / (F.lit(float(classes)) * F.col("size__")))  # a row a class
    ready = VectorAssembler(inputCols=features, outputCol="features__").transform(balanced).withColumn("label__", F.col(label).cast("double"))
    forest = RandomForestClassifier(featuresCol="features__", labelCol="label__", weightCol="weight__", numTrees=trees, maxDepth=depth, seed=seed)
    out = None
    for k in sorted(r[0] for r in df.select(fold).distinct().collect()):
        model = forest.fit(ready.where(F.col(fold) != k))
        part = model.transform(ready.where(F.col(fold) == k)).withColumn("score", vector_to_array("probability")[1])
        part = part.select(*df.columns, "score")
        out = part if out is None else out.unionByName(part)
    weights = forest.fit(ready).featureImportances
    return out, sorted(((f, float(weights[i])) for i, f in enumerate(features)), key=lambda t: -t[1])


class _Boxes:
    """Points in halves of halves along their widest side, down to leaves of some `leaf` points; levels[i] has 2 ** i boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 8):
        n = len(points)
        self.order, self.levels = np.arange(n), []
        depth = max(0, (n // leaf).bit_length() - 1)
        for level in range(depth + 1):
            bounds = (np.arange(2**level + 1) * n) >> level
            p = points[self.order]
            low, high = np.minimum.reduceat(p, bounds[:-1]), np.maximum.reduceat(p, bounds[:-1])
            self.levels.append((low, high, np.minimum.reduceat(sizes[self.order], bounds[:-1])))
            node = np.repeat(np.arange(2**level), np.diff(bounds))
            if level < depth:
                self.order = self.order[np.lexsort((p[np.arange(n), (high - low).argmax(1)[node]], node))]
        width = int(np.diff(bounds).max())
        place = bounds[:-1, None] + np.arange(width)
        self.leaf_of, self.filled = node, place < bounds[1:, None]
        self.members = self.order[np.minimum(place, n - 1)]


def _nearest(points: np.ndarray, sizes: np.ndarray, names: np.ndarray, asked: np.ndarray, most: float, chunk: int = 16384) -> tuple[np.ndarray, np.ndarray]:
    """For each asked cluster (a place in points) the one at the least squared Ward distance below `most`, or -1, and that.

    Exact: a box is left out only where no point of it can be as near as what is found. Of equal distances that of the
    least hash of the pair's names is taken, so that both sides of a pair decide alike.
    """
    boxes = _Boxes(points, sizes)
    picked = boxes.order[is_asked := np.isin(boxes.order, asked)]
    leaf = boxes.leaf_of[is_asked]
    best, found = np.full(len(points), most), np.full(len(points), -1)
    for c in range(0, len(picked), chunk):
        q, own = picked[c : c + chunk], leaf[c : c + chunk]
        qp, qs = points[q], sizes[q]

        def compare(g: np.ndarray, r: np.ndarray) -> None:
            ids, a = boxes.members[r], qp[g]
            f = np.zeros(ids.shape)
            for k in range(points.shape[1]):
                f += (a[:, k, None] - points[ids, k]) ** 2
            sa, sb = qs[g][:, None], sizes[ids]
            f *= sa * sb * 2 / (sa + sb)
            f[(q[g][:, None] == ids) | ~boxes.filled[r]] = np.inf
            at = f.argmin(1)
            rows = np.arange(len(g))
            least = f[rows, at]
            equal = f == least[:, None]
            for i in np.flatnonzero((equal.sum(1) > 1) & np.isfinite(least)):  # ties within a leaf
                same = np.flatnonzero(equal[i])
                at[i] = same[_pair_hash(names[q[g[i]]], names[ids[i, same]]).argmin()]
            near, mine = ids[rows, at], q[g]
            was, held = best[mine], found[mine]
            wins = least < was
            tied = np.flatnonzero((least == was) & (held >= 0))
            wins[tied] = _pair_hash(names[mine[tied]], names[near[tied]]) < _pair_hash(names[mine[tied]], names[held[tied]])
            best[mine[wins]], found[mine[wins]] = least[wins], near[wins]

        every = np.arange(len(q))
        compare(every, own)
        g, node, floor = every, np.zeros(len(q), np.int64), np.zeros(len(q))
        for box_low, box_high, box_small in boxes.levels[1:]:
            g, node = np.repeat(g, 2), np.repeat(node * 2, 2)
            node[1::2] += 1
            floor = np.zeros(len(g))
            for k in range(points.shape[1]):
                at = qp[g, k]
                floor += (at - np.clip(at, box_low[node, k], box_high[node, k])) ** 2
            floor *= 2 * qs[g] * box_small[node] / (qs[g] + box_small[node]) * (1 - 1e-12)
            keep = floor <= best[q[g]]
            g, node, floor = g[keep], node[keep], floor[keep]
        keep = node != own[g]
        g, node, floor = g[keep], node[keep], floor[keep]
        order = np.lexsort((floor, g))
        g, node, floor = g[order], node[order], floor[order]
        while len(g):
            lead = np.r_[True, g[1:] != g[:-1]]  # the nearest box left of each
            compare(g[lead], node[lead])
            keep = ~lead & (floor <= best[q[g]])
            g, node, floor = g[keep], node[keep], floor[keep]
    return found[asked], best[asked]


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.atleast_1d(np.minimum(a, b)).astype(np.uint64), np.atleast_1d(np.maximum(a, b)).astype(np.uint64)
    h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def ward(points: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Labels of agglomerative clustering that merges while the Ward distance is below a threshold.

    Merges all pairs that are each other's nearest, round by round: Ward's distance to a merged pair is not below the
    lesser of those to its parts, so this gives the same clusters as one merge after another (where no distances are
    equal), and who has none below the threshold is done. Nearest ones are found through boxes; memory is linear. sizes:
    points that each row stands for. Labels follow each cluster's first point.
    """
    n = len(points)
    centre, size = points.astype(float).copy(), np.ones(n) if sizes is None else sizes.astype(float)
    parent, near, far = np.arange(n), np.full(n, -1), np.full(n, np.inf)
    live, stale = np.arange(n), np.ones(n, bool)
    while len(live) > 1:
        asked = np.flatnonzero(stale[live])
        at, squared = _nearest(centre[live], size[live], live, asked, threshold**2)
        near[live[asked]], far[live[asked]] = np.where(at >= 0, live[at], -1), squared
        live = live[near[live] >= 0]
        if not len(live):
            break
        low = live[(near[near[live]] == live) & (live < near[live])]
        if not len(low):
            low = live[[far[live].argmin()]]  # rounding made neighbours disagree: the nearest pair of all
        pair = near[low]
        low, high = np.minimum(low, pair), np.maximum(low, pair)
        whole = size[low] + size[high]
        centre[low] = (centre[low] * size[low, None] + centre[high] * size[high, None]) / whole[:, None]
        size[low], parent[high] = whole, low
        moved = np.zeros(n, bool)
        moved[low] = moved[high] = True
        live = live[parent[live] == live]
        stale = moved.copy()
        stale[live] |= moved[near[live]]
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return np.unique(parent, return_inverse=True)[1]


def ward_clusters(df: DataFrame, id: str, features: list[str], threshold: float, *, limit: int = 10_000_000) -> DataFrame:
    """(id, cluster): Ward clustering of the standardised features.

    Any two clusters may merge, so it is one task over distinct feature rows (equal rows are one row that stands for all
    of them); some 200 bytes a row. More than `limit` of them is an error when computed, not a cut.
    """
    import pyarrow as pa

    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    stats = df.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)], *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(x)])
    scaled = df.crossJoin(F.broadcast(stats)).select(F.col(id), F.array(*[F.coalesce(F.try_divide(v - F.col(f"m{i}"), F.nullif(F.col(f"s{i}"), F.lit(0.0))), F.lit(0.0)) for i, v in enumerate(x)]).alias("x"))  # one row

    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > limit:
            raise ValueError(f"{table.num_rows} distinct rows are more than the limit of {limit}")
        table = table.sort_by("first").combine_chunks()
        points = np.concatenate([c.flatten().to_numpy() for c in table["x"].chunks]).reshape(-1, len(features))
        label = ward(points, threshold, table["n"].to_numpy())
        return pa.table({"x": table["x"].cast(pa.list_(pa.field("element", pa.float64()))), "cluster": pa.array(label, pa.int64())})

    found = scaled.groupBy("x").agg(F.min(id).alias("first"), F.count(F.lit(1)).alias("n")).groupBy().applyInArrow(run, "x array<double>, cluster long")
    return scaled.join(found, "x").select(id, "cluster")
