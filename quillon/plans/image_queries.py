"""Image sources, kernels and preprocessing over frames that are drawn from the embeddings (there are no image data)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import pixels as P
from ..functions.scalar import draw, r6
from ..sources import folders, stacks
from ..sources.predictions import temporary_folder
from .bindings import table
from .registry import query

HEIGHT, WIDTH = 96, 104


def drawn(vec: np.ndarray, number: int) -> np.ndarray:
    """A frame: a textured disk on black, with a black box in every fourth."""
    tone = np.kron(np.clip(128 + 90 * np.asarray(vec, float)[:64].reshape(8, 8), 25, 230), np.ones((12, 13)))
    y, x = np.indices((HEIGHT, WIDTH))
    tone = tone + (x * 7 + y * 3 + number) % 5
    tone[(x - 50 - number % 5) ** 2 + (y - 48) ** 2 > 42**2] = 0
    if number % 4 == 0:
        tone[36:54, 40:58] = 0
    return np.clip(tone[:, :, None] * np.array([1.05, 0.9, 0.8]), 0, 255).astype(np.uint8)


def frames(s, d):
    """vec_id, label, height, width, channels, pixels."""

    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"vec_id": b.vec_id, "label": b.label, "height": HEIGHT, "width": WIDTH, "channels": 3, "pixels": [drawn(v, i).tobytes() for v, i in zip(b.embedding, b.vec_id, strict=True)]})

    return table(s, d, "embeddings").select("vec_id", "label", "embedding").mapInPandas(run, f"vec_id long, label int, {P.FRAME}")


def _fov(s, d):
    found = P.map_frames(frames(s, d), ["vec_id"], "cx double, cy double, radius double, fit_quality double, area_pct double", lambda img: [P.field_of_view(img) or (None,) * 5])
    return found.drop("error")


def _with_fov(s, d):
    return frames(s, d).join(_fov(s, d), "vec_id")


@query("i01_simple_hashes")
def i01h(s, d):
    """Average and difference hashes of whole frames."""
    return P.map_frames(frames(s, d), ["vec_id"], "ahash long, dhash long", lambda img: [P.simple_hashes(img)])


@query("i02_frequency_hash")
def i02(s, d):
    """The hash of each frame's inner square."""
    from ..functions import kernels as K

    boxed = _with_fov(s, d).withColumn("c", K.crop_box(F.col("radius"), F.col("fit_quality"), F.lit(WIDTH), F.lit(HEIGHT), F.col("cx"), F.col("cy")))
    boxed = boxed.select("vec_id", "height", "width", "channels", "pixels", F.array(*[F.col(f"c.box.{x}") for x in ("left", "top", "right", "bottom")]).alias("box"))
    return P.map_frames(boxed, ["vec_id"], "phash long", lambda img, box: [(P.frequency_hash(img, tuple(box)),)], "box")


@query("i03_field_of_view")
def i03(s, d):
    return _fov(s, d).select("vec_id", *[r6(c).alias(c) for c in ("cx", "cy", "radius", "fit_quality", "area_pct")])


@query("i06_colour_statistics")
def i06(s, d):
    columns = "mean_r double, mean_g double, mean_b double, rg_ratio double, bg_ratio double"
    return P.map_frames(_with_fov(s, d), ["vec_id"], columns, lambda img, cx, cy, r: [P.colour_means(img, cx, cy, r)], "cx", "cy", "radius")


@query("i07_compression_indicators")
def i07(s, d):
    columns = "blockiness_ratio double, unique_colour_count long, unique_colour_frac double, high_freq_energy_ratio double, dct_comb_score double"
    return P.map_frames(_with_fov(s, d), ["vec_id"], columns, lambda img, cx, cy, r: [P.compression_indicators(img, cx, cy, r)], "cx", "cy", "radius")


@query("i08_redactions")
def i08(s, d):
    """Per frame: whether it has redactions, their number and share of the frame, and the largest one's box (the first of equals)."""
    columns = "area long, fill_ratio double, left long, top long, right long, bottom long"
    boxes = P.map_frames(_with_fov(s, d), ["vec_id"], columns, lambda img, cx, cy, r: P.dark_boxes(img.mean(axis=2), cx, cy, r), "cx", "cy", "radius")
    g = boxes.groupBy("vec_id").agg(F.count("area").alias("redaction_count"), F.sum("area").alias("area"), F.max_by(F.struct("left", "top", "right", "bottom"), F.struct("area", -F.col("top"), -F.col("left"))).alias("b"))
    pct = F.coalesce(100.0 * F.col("area") / (HEIGHT * WIDTH), F.lit(0.0))
    out = frames(s, d).select("vec_id").join(g, "vec_id", "left")
    return out.select("vec_id", (F.coalesce("redaction_count", F.lit(0)) > 0).alias("has_redaction"), F.coalesce("redaction_count", F.lit(0)).alias("redaction_count"), r6(pct).alias("redaction_area_pct"), *[F.col(f"b.{c}").alias(f"largest_{c}") for c in ("left", "top", "right", "bottom")])


@query("i09_coerced_frames")
def i09(s, d):
    """Greyscale, RGBA, 16-bit and floating-point versions of each frame, as 8-bit RGB: their mean values."""

    def forms(img):
        grey = img[:, :, 0]
        kinds = [("grey", grey), ("one channel", grey[:, :, None]), ("rgba", np.dstack([img, grey])), ("16 bits", img.astype(np.uint16) * 257), ("shares", img.astype(float) / 255), ("float", img.astype(float))]
        return [(name, *map(float, P.rgb8(a).mean((0, 1)))) for name, a in kinds]

    return P.map_frames(frames(s, d), ["vec_id"], "form string, mean_r double, mean_g double, mean_b double", forms)


@query("i10_model_input")
def i10(s, d):
    """Cropped, resized twice and standardised (at a tenth of the usual sizes): mean and deviation of each channel."""

    def run(img, cx, cy, r):
        x = P.model_input(img, (int(cx - r / 2), int(cy - r / 2), int(cx + r / 2), int(cy + r / 2)), 43, 38)
        return [(c, float(x[c].mean()), float(x[c].std())) for c in range(3)]

    return P.map_frames(_with_fov(s, d), ["vec_id"], "channel int, mean double, sd double", run, "cx", "cy", "radius")


@query("i13_colour_arms")
def i13(s, d):
    """Mean colours under each colour normalisation; the reference of the matched arm is that of the labels below 5."""
    of_lab = lambda img: [(c, float(v[..., c].mean()), float(v[..., c].std())) for v in [P.lab(img)] for c in range(3)]
    stats = P.map_frames(frames(s, d).where("label < 5"), ["vec_id"], "channel int, mean double, sd double", of_lab)
    rows = {r.channel: r for r in stats.groupBy("channel").agg(F.avg("mean").alias("mean"), F.avg("sd").alias("sd")).collect()}  # three rows
    if not rows:
        return P.map_frames(frames(s, d).where("false"), ["vec_id"], "arm string, mean_r double, mean_g double, mean_b double", lambda img: [])
    mean, sd = (np.array([getattr(rows[c], k) for c in range(3)]) for k in ("mean", "sd"))

    def arms(img):
        made = [("control", img), ("matched", P.matched_colours(img, mean, sd)), ("grey world", P.grey_world(img)), ("z-score", P.own_scale(img))]
        return [(name, *map(float, a.mean((0, 1)))) for name, a in made]

    return P.map_frames(frames(s, d), ["vec_id"], "arm string, mean_r double, mean_g double, mean_b double", arms)


def votes(img: np.ndarray) -> np.ndarray:
    """Five masks of a frame, at rising brightness."""
    return np.stack([img[:, :, 0] > t for t in (90, 110, 130, 150, 170)])


@query("i14_lesion_rings")
def i14r(s, d):
    """The largest region that three of five masks agree on, red matched to the frame's ratio, and the ring difference."""

    def run(img):
        mask = P.largest(votes(img).sum(0) >= 3, diagonal=True)
        matched = P.red_matched(img, mask, 1.2)
        delta, outside, inside = P.ring_difference(matched, mask)
        return [(int(mask.sum()), float(matched[..., 0].mean()), delta, outside, inside)]

    return P.map_frames(frames(s, d), ["vec_id"], "lesion_px long, mean_r double, halo_ring_delta_lab double, ring_out_px long, ring_in_px long", run)


@query("i15_views")
def i15(s, d):
    """Eleven views of each frame's kept square (at a tenth of the usual sizes): their mean and first pixel."""
    views = lambda img: [(k, float(v.mean()), int(v[0, 0, 0])) for k, v in enumerate(P.views(P.resized(img, 43), 38))]
    return P.map_frames(frames(s, d), ["vec_id"], "view int, mean double, corner int", views)


@query("b13_null_distribution")
def b13(s, d):
    """Ring differences of frames' own regions (null a), of random blocks on frames without a box (null b, 500 draws by a
    keyed hash), and of shifted regions (the case); how many cases exceed each null's 95th percentile."""
    own = lambda img: [(P.ring_difference(img, P.largest(votes(img).sum(0) >= 3, diagonal=True))[0],)]
    f = frames(s, d)

    def moved(img):
        return [(P.ring_difference(img, np.roll(P.largest(votes(img).sum(0) >= 3, diagonal=True), (9, 9), (0, 1)))[0],)]

    plain = f.where("vec_id % 4 <> 0").select("vec_id")
    n = plain.count()
    from ..operators.windows import numbered

    ids = numbered(plain, [], "vec_id", name="place")
    plan = s.range(500).select(F.col("id").alias("draw")).withColumn("place", (draw("null", "row", F.col("draw")) % max(1, n) + 1).cast("int"))
    plan = plan.join(ids, "place").join(f.select("vec_id", "height", "width", "channels", "pixels"), "vec_id").withColumn("u", draw("null", "shape", F.col("draw")))

    def blob(img, u):
        rng = np.random.default_rng(u)
        side = int(rng.uniform(0.2, 0.45) * 59)
        y, x = 20 + rng.integers(0, 59 - side), 20 + rng.integers(0, 59 - side)
        mask = np.zeros(img.shape[:2], bool)
        mask[y : y + side, x : x + side] = True
        return [(P.ring_difference(img, mask)[0],)]

    one = lambda df, keep, run, name, *more: P.map_frames(df, keep, "delta double", run, *more).select(F.lit(name).alias("kind"), "delta").where("delta is not null")
    every = one(f, ["vec_id"], moved, "case").unionByName(one(f, ["vec_id"], own, "null a")).unionByName(one(plan, ["draw"], blob, "null b", "u"))
    q = F.percentile("delta", F.array(F.lit(0.5), F.lit(0.95)))
    summary = every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delta")).alias("mean"), r6(F.stddev_pop("delta")).alias("sd"), q.alias("q"), F.max("delta").alias("most"))
    summary = summary.select("kind", "n", "mean", "sd", r6(F.get("q", F.lit(0))).alias("median"), F.get("q", F.lit(1)).alias("p95"), "most")
    cases = every.where("kind = 'case'").select(F.col("delta").alias("case_delta"))
    over = summary.join(cases, F.lit(True)).groupBy("kind").agg(r6(F.avg((F.col("case_delta") > F.col("p95")).cast("double"))).alias("cases_above_p95"))  # three rows
    return summary.join(over, "kind")


# ---- sources


def _written_stack(s, d, big: bool = False) -> str:
    rows = table(s, d, "embeddings").orderBy("vec_id").limit(200).collect()  # a fixture: the stack's file is written by the driver
    path = f"{temporary_folder(s)}/a.tif"
    stacks.write_tiff(path, [np.floor(np.abs(np.asarray(r.embedding, float)) * 100 % 256).astype(np.uint8).reshape(8, 8) for r in rows], big=big)
    return path


_PAGES = "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS index, CAST(8 AS INTEGER) AS height, CAST(8 AS INTEGER) AS width, CAST(list_sum(list_transform(embedding, lambda x: CAST(floor((abs(x::DOUBLE) * 100) % 256) AS BIGINT))) AS BIGINT) AS total FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 200)"


def _totals(df):
    def run(batches):
        import pandas as pd

        for b in batches:
            yield pd.DataFrame({"index": b["index"], "height": b.height, "width": b.width, "total": [int(np.frombuffer(p, k).astype(np.int64).sum()) for p, k in zip(b.pixels, b.kind, strict=True)]})

    return df.mapInPandas(run, "index long, height int, width int, total long")


@query("s10_tiff_stack", _PAGES)
def s10(s, d):
    return _totals(stacks.read_stack(s, _written_stack(s, d), 16))


@query("s10_bigtiff_stack", _PAGES)
def s10b(s, d):
    return _totals(stacks.read_stack(s, _written_stack(s, d, big=True), 16))


@query("s11_volume_stack", _PAGES)
def s11(s, d):
    """The same frames as a MetaImage volume."""
    import pyarrow.fs as fs

    rows = table(s, d, "embeddings").orderBy("vec_id").limit(200).collect()
    path = f"{temporary_folder(s)}/a.mha"
    data = b"".join(np.floor(np.abs(np.asarray(r.embedding, float)) * 100 % 256).astype(np.uint8).tobytes() for r in rows)
    system, inside = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    system.create_dir(inside.rsplit("/", 1)[0])
    with system.open_output_stream(inside) as f:
        f.write(f"ObjectType = Image\nNDims = 3\nDimSize = 8 8 {len(rows)}\nElementType = MET_UCHAR\nElementDataFile = LOCAL\n".encode() + data)
    return _totals(stacks.read_stack(s, path, 16))


@query("s12_find_stack", "SELECT 'a.tif' AS chosen, CAST(1 AS BIGINT) AS left_out")
def s12(s, d):
    path = _written_stack(s, d)
    stacks.write_tiff(path.replace("a.tif", "b.tiff"), [np.zeros((2, 2), np.uint8)])
    chosen, others = stacks.find_stack(s, path.rsplit("/", 1)[0])
    return s.createDataFrame([(chosen.rsplit("/", 1)[-1], len(others))], "chosen string, left_out long")


_FOLDERS = [("center_1", "neo"), ("center_1", "ndbe"), ("center_2", "NEO"), ("center_2", "non_dysplastic")]


def _written_folders(s) -> str:
    root = f"{temporary_folder(s)}/data_set/images"
    for k, (centre, name) in enumerate(_FOLDERS):
        for i in range(k + 2):
            stacks.write_tiff(f"{root}/{centre}/{name}/{i}.tif", [np.full((2, 2 + i), k, np.uint8)])
    stacks.write_tiff(f"{root}/scripts/neo/x.tif", [np.zeros((2, 2), np.uint8)])
    return root


@query("s06_image_files", "SELECT * FROM (VALUES ('center_1', 'neoplasia', CAST(2 AS BIGINT)), ('center_1', 'non-dysplastic', 3), ('center_2', 'neoplasia', 4), ('center_2', 'non-dysplastic', 5)) t(centre, class_label, n)")
def s06(s, d):
    return folders.image_files(s, _written_folders(s)).groupBy("centre", "class_label").agg(F.count(F.lit(1)).alias("n"))


@query("s07_dataset_root", "SELECT 'images' AS root")
def s07(s, d):
    found = folders.locate_root(s, _written_folders(s).rsplit("/", 2)[0])
    return s.createDataFrame([(found.rsplit("/", 1)[-1],)], "root string")
