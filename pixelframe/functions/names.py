"""Scene names, tile names and labels as column expressions; unknown shapes give null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _part(name: Column, i: int) -> Column:
    return F.try_element_at(F.split(name, "_"), F.lit(i))


def product_type(name: Column) -> Column:
    n = F.size(F.split(name, "_"))
    return F.when(n == 3, "PSScene").when(n == 4, F.when(F.length(_part(name, 1)) == 8, "PSScene").otherwise("PSOrthoTile"))


def image_date(name: Column) -> Column:
    return _part(name, 3)


def tile_id(name: Column) -> Column:
    return _part(name, 2)


def parse_scene_id(name: Column) -> Column:
    """struct<take_id, tile_id, date, satellite, year>; dates as YYYY-MM-DD."""
    kind = product_type(name)
    day = F.concat_ws("-", F.substring(_part(name, 1), 1, 4), F.substring(_part(name, 1), 5, 2), F.substring(_part(name, 1), 7, 2))
    tile = kind == "PSOrthoTile"
    date = F.when(tile, _part(name, 3)).when(kind == "PSScene", day)
    return F.struct(
        F.when(tile, _part(name, 1)).when(kind == "PSScene", _part(name, 2)).alias("take_id"),
        F.when(tile, _part(name, 2)).alias("tile_id"),
        date.alias("date"),
        F.when(kind.isNotNull(), _part(name, -1)).alias("satellite"),
        F.year(F.try_to_timestamp(date, F.lit("yyyy-MM-dd"))).alias("year"),
    )


def tile_product_type(stem: Column) -> Column:
    p = F.split(stem, "_")
    return F.when(F.try_element_at(p, F.lit(-4)) == "BGRN", "OrthoTile").when((F.size(p) == 6) & (F.length(F.try_element_at(p, F.lit(3))) == 6), "Sentinel2").otherwise("Scene")


def tile_key(stem: Column) -> Column:
    """struct<row, col>: the last two parts."""
    return F.struct(_part(stem, -2).try_cast("int").alias("row"), _part(stem, -1).try_cast("int").alias("col"))


def aux_key(other: Column, row: Column, col: Column) -> Column:
    return F.concat_ws("_", other, row.cast("string"), col.cast("string"))


def threshold_label(t: Column) -> Column:
    return F.concat(F.lit("class_"), F.replace(t.cast("string"), F.lit("."), F.lit("")))


def strip_clip(name: Column) -> Column:
    return F.replace(name, F.lit("_clip"), F.lit(""))


def stage_status(codes: Column) -> Column:
    """Map of stage codes 0, 1, 2 -> failed, success, skipped."""
    return F.transform_values(codes, lambda k, v: F.element_at(F.array(*map(F.lit, ("failed", "success", "skipped"))), v + 1))
