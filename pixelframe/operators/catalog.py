"""Scene catalog: listing, processing status, what is left to do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names as N

CATALOG = "path string, name string, preprocessed boolean, product_type string, image_date string, tile_id string"


def scene_files(spark: SparkSession, root: str) -> DataFrame:
    """path, scene_dir, name, file, length for every file under root; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    where = F.regexp_extract("path", r"^(.*)/[^/]+$", 1)
    return files.select("path", where.alias("scene_dir"), F.regexp_extract(where, r"([^/]+)$", 1).alias("name"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


def file_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("scene_dir", "name").agg(F.count("*").alias("n_files"))


def clip_renames(files: DataFrame, folder: str = "scene_dir", file: str = "file") -> DataFrame:
    """folder, file, target, renamed, status for every file with _clip in its name: a target that is there already is kept, and
    the file stays as it is. status is 1, as it is in clip_status for each folder with such files."""
    there = files.select(folder, F.col(file).alias("target"), F.lit(True).alias("_there")).distinct()
    clips = files.where(F.col(file).contains("_clip")).select(folder, file, N.strip_clip(F.col(file)).alias("target"))
    return clips.join(there, [folder, "target"], "left").select(folder, file, "target", F.col("_there").isNull().alias("renamed"), F.lit(1).alias("status"))


def clip_status(files: DataFrame, folder: str = "scene_dir", file: str = "file") -> DataFrame:
    """folder, status: 1 if it holds files with _clip in their names, 2 if it does not."""
    return files.groupBy(folder).agg(F.when(F.bool_or(F.col(file).contains("_clip")), 1).otherwise(2).alias("status"))


def scene_catalog(scenes: DataFrame, preprocessed: bool = False, path: str = "path") -> DataFrame:
    """name (and path) -> the catalog's six columns; no rows give the empty schema."""
    at = F.col(path) if path in scenes.columns else F.lit(None).cast("string")
    n = F.col("name")
    return scenes.select(at.alias("path"), "name", F.lit(preprocessed).alias("preprocessed"), N.product_type(n).alias("product_type"), N.image_date(n).alias("image_date"), N.tile_id(n).alias("tile_id"))


def file_roles(files: DataFrame, images=("_SR.tif", "_SR_clip.tif", "_AnalyticMS.tif"), fail_on_missing_mask: bool = True, keys: tuple = ("name",)) -> DataFrame:
    """keys, udm, udm2, images, others; a scene with no mask fails if asked. keys tell scenes apart: more than the name (which
    is one of them) where scenes share names."""
    f = F.col("file")
    is_udm2, is_udm = F.lower(f).contains("udm2"), F.lower(f).contains("udm") & ~F.lower(f).contains("udm2")
    is_image = F.lit(False)
    for suffix in images:
        is_image |= f.endswith(suffix)
    out = files.groupBy(*keys).agg(F.max(F.when(is_udm, f)).alias("udm"), F.max(F.when(is_udm2, f)).alias("udm2"), F.array_sort(F.collect_list(F.when(is_image, f))).alias("images"), F.array_sort(F.collect_list(F.when(~(is_image | is_udm | is_udm2), f))).alias("others"))
    if fail_on_missing_mask:
        fine = F.col("udm").isNotNull() | F.col("udm2").isNotNull()
        out = out.where(F.when(fine, True).otherwise(F.raise_error(F.concat(F.lit("no usable-data mask: "), F.col("name"))).cast("boolean")))
    return out


def processing_status(raw: DataFrame, processed: DataFrame, finished: DataFrame, min_files: int = 5, keys: tuple = ("name",)) -> DataFrame:
    """raw: keys (as in file_roles); processed: keys, n_files; finished: keys -> keys, preprocessed, inference_finished: one
    union with flags, one shuffle by keys."""
    flags = ("done", "raw", "finished")
    kinds = (processed.where(F.col("n_files") >= min_files), raw, finished)
    every = reduce(DataFrame.unionByName, [df.select(*keys, *[F.lit(f == flag).alias(f) for f in flags]) for df, flag in zip(kinds, flags)])
    scenes = every.groupBy(*keys).agg(*[F.bool_or(f).alias(f) for f in flags]).where("done or raw")
    return scenes.select(*keys, F.col("done").alias("preprocessed"), F.col("finished").alias("inference_finished"))


def processing_stats(status: DataFrame) -> DataFrame:
    p, f = F.col("preprocessed"), F.col("inference_finished")
    return status.agg(F.count("*").alias("total"), F.count_if(p).alias("preprocessed"), F.count_if(~p).alias("to_preprocess"), F.count_if(p & ~f).alias("to_infer"), F.count_if(f).alias("finished"))


def merge_status(*statuses: DataFrame) -> DataFrame:
    """Union of status tables, one row per name (the one that is furthest)."""
    out = statuses[0]
    for s in statuses[1:]:
        out = out.unionByName(s)
    return out.groupBy("name").agg(F.max("preprocessed").alias("preprocessed"), F.max("inference_finished").alias("inference_finished"))


def to_process(status: DataFrame, max_images: int | None = None) -> DataFrame:
    out = status.where("preprocessed and not inference_finished").orderBy("name")
    return out.limit(max_images) if max_images else out


def incomplete_inputs(counts: DataFrame, min_files: int = 4) -> DataFrame:
    return counts.where(F.col("n_files") < min_files)


def ensemble_status(products: DataFrame, models: list[str], ensemble: str, keys: tuple = ("name",)) -> DataFrame:
    """products: keys (as in file_roles), model, has_proba -> one row per scene with a flag for each model: one shuffle for
    all of them."""
    wide = products.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(F.col("model") == m, F.lit(True))), F.lit(False)).alias(f"has_{m}") for m in [*models, ensemble]], *[F.coalesce(F.max(F.when(F.col("model") == m, F.col("has_proba"))), F.lit(False)).alias(f"proba_{m}") for m in models])
    every = lambda p: F.forall(F.array(*[F.col(f"{p}_{m}") for m in models]), lambda x: x)
    out = wide.withColumn("data_available", every("has")).withColumn("proba_available", every("proba"))
    return out.withColumn("process", F.col("data_available") & F.col("proba_available") & ~F.col(f"has_{ensemble}"))


def single_match(files: DataFrame, pattern: str, keys: tuple = ("name",)) -> DataFrame:
    """keys (as in file_roles), file of each scene's one file that matches; more or fewer fail."""
    found = files.groupBy(*keys).agg(F.count_if(F.col("file").rlike(pattern)).alias("c"), F.max(F.when(F.col("file").rlike(pattern), F.col("file"))).alias("file"))
    return found.where(F.when(F.col("c") == 1, True).otherwise(F.raise_error(F.concat(F.lit("not one match: "), F.col("name"))).cast("boolean"))).drop("c")
