"""Image folders: where a dataset's root is, and its image files."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a class folder's name holds (spaces left out, "_" as "-"), the negative words first.
NEGATIVE = ("ndbe", "non-dys", "nondys", "non-neo", "nonneo", "negative", "benign", "normal", "control")
POSITIVE = ("neo", "dysplasia", "dysplastic", "positive", "hgd", "malignant", "abnormal", "cancer")
IMAGES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".gif", ".webp")
SKIPPED = ("manifests", "scripts", "__pycache__", ".git", ".qodo")


def class_of(folder: str) -> str:
    name = folder.lower().replace(" ", "").replace("_", "-")
    holds = lambda words: any(w in name for w in words)
    return "non-dysplastic" if holds(NEGATIVE) else "neoplasia" if holds(POSITIVE) else "unknown"


def locate_root(spark: SparkSession, base: str, *, max_depth: int = 6) -> str:
    """The folder over all class folders that hold images: their one grandparent, else their one parent, else the
    shallowest parent. Folders are listed down to max_depth; hidden and skipped ones are left out."""
    top = spark._jvm.org.apache.hadoop.fs.Path(base)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found, level = [], [(top, 0)]
    while level:
        path, depth = level.pop()
        entries = list(system.listStatus(path))
        names = [e.getPath().getName() for e in entries if e.isFile()]
        if class_of(path.getName()) != "unknown" and any(n.lower().endswith(IMAGES) for n in names):
            found.append(path)
        if depth < max_depth:
            level += [(e.getPath(), depth + 1) for e in entries if e.isDirectory() and not e.getPath().getName().startswith(".") and e.getPath().getName() not in SKIPPED]
    if not found:
        raise FileNotFoundError(f"no class folder with images under {base}")
    parents = Counter(p.getParent().toString() for p in found)
    above = Counter(p.getParent().getParent().toString() for p in found)
    for names in (above, parents):
        if len(names) == 1:
            return next(iter(names))
    return min(parents, key=lambda p: (p.count("/"), p))


def image_files(spark: SparkSession, root: str) -> DataFrame:
    """path (below the root), centre, class_label, bytes of all image files, hidden and skipped folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(s[1:] for s in IMAGES) + "}").load(root)
    below = F.regexp_replace("path", "^.*?" + root.split("://")[-1].replace("file:", "").rstrip("/").replace(".", r"\.") + "/", "")
    skipped = "(^|/)(\\.[^/]*|" + "|".join(SKIPPED) + ")/"
    parts = F.split("below", "/")
    label = F.when(F.size(parts) < 2, "unknown")
    folder = F.replace(F.replace(F.lower(F.element_at(parts, -2)), F.lit(" ")), F.lit("_"), F.lit("-"))
    for words, name in ((NEGATIVE, "non-dysplastic"), (POSITIVE, "neoplasia")):
        for w in words:
            label = label.when(F.contains(folder, F.lit(w)), name)
    centre = F.when(F.size(parts) >= 3, F.element_at(parts, -3)).otherwise("unknown")
    return files.select(below.alias("below"), F.col("length").alias("bytes")).where(~F.col("below").rlike(skipped)).select(F.col("below").alias("path"), centre.alias("centre"), label.otherwise("unknown").alias("class_label"), "bytes")
