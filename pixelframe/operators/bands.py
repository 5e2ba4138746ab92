"""Band algebra, masks and nodata. Three encodings of nodata meet here: 0 in all bands, NaN in probabilities, 255 in
binaries; NaN never passes a threshold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: Sources with channels and normalisation factors, in order of name.
SOURCES = {"ndvi": (1, 20000.0), "planet": (4, 3000.0), "relative_elevation": (1, 30000.0), "slope": (1, 90.0), "tcvis": (3, 255.0)}


def above(p: Column, t, inclusive: bool = True) -> Column:
    """p >= t (or > t) with NaN as false."""
    t = t if isinstance(t, Column) else F.lit(t)
    return F.coalesce(~F.isnan(p) & ((p >= t) if inclusive else (p > t)), F.lit(False))


def ndvi(red: Column, nir: Column) -> Column:
    there = (red + nir) != 0
    return F.when(there, F.bround(((nir - red) / F.when(there, nir + red) + 1) * 1e4)).otherwise(0).cast("int")


def udm2_mask(b: Column) -> Column:
    """Usable: clear and neither nodata nor any of the unusable classes."""
    at = lambda i: F.get(b, F.lit(i))
    return (at(0) == 1) & ~((at(7) == 1) | (F.greatest(at(1), at(2), at(4), at(5)) == 1))


def udm2_nodata(b: Column, bands=(1, 2, 4, 5), nodata: int = 1) -> Column:
    return F.greatest(*[F.get(b, F.lit(i)) for i in bands]) == nodata


def udm_mask(b0: Column, nodata: int = 1) -> Column:
    return (b0 >= nodata).cast("int")


def burn_mask(df: DataFrame, bands: list[str], usable: Column, value=0) -> DataFrame:
    return df.withColumns({b: F.when(usable, F.col(b)).otherwise(value) for b in bands})


def nodata_flag(cols: list[Column]) -> Column:
    return reduce(lambda a, c: a & (c == 0), cols[1:], cols[0] == 0)


def normalise(value: Column, factor: float) -> Column:
    return F.nanvl(value, F.lit(0.0)) / F.lit(factor)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def activated(df: DataFrame, col: str, keys: list[str]) -> DataFrame:
    """df with the sigmoid of col where any value of the batch (keys) lies outside 0..1, else as it is."""
    some = df.groupBy(*keys).agg(F.max((F.col(col) < 0) | (F.col(col) > 1)).alias("_any"))
    both = df.join(some, keys) if keys else df.crossJoin(F.broadcast(some))  # one row
    return both.withColumn(col, F.when(F.col("_any"), sigmoid(F.col(col))).otherwise(F.col(col))).drop("_any")


def masked_pixels(image: DataFrame, mask: DataFrame, keys: list[str], bands: list[str], usable: str = "usable", value: float = 0) -> DataFrame:
    """Image pixels with bands set to value where the mask of the same pixel is not usable; pixels without a mask fail."""
    m = image.join(mask.select(*keys, "y", "x", F.col(usable).alias("_ok")), [*keys, "y", "x"], "left")
    m = m.where(F.when(F.col("_ok").isNotNull(), True).otherwise(F.raise_error(F.lit("pixel without a mask")).cast("boolean")))
    return burn_mask(m, bands, F.col("_ok"), value).drop("_ok")


def trim(bands: Column, n: int) -> Column:
    """The first n bands, NaN as 0."""
    return F.transform(F.slice(bands, 1, n), lambda v: F.nanvl(v, F.lit(0.0)))


def binarise(p: Column, nodata: Column, t: float = 0.5) -> Column:
    return F.when(nodata, 255).otherwise(above(p, t, False).cast("int")).cast("smallint")


def relative_elevation(dem: Column, focal_mean: Column, decimals: int | None = None) -> Column:
    """Cut to an integer; with decimals the value is rounded to these first, so that sums in any order agree."""
    raw = (dem - focal_mean + 30) * 300
    return (raw if decimals is None else F.round(raw, decimals)).cast("int").cast("smallint")


def encoder_preprocess(bands: Column, mean: list[float], std: list[float], flip: bool = False, unit_range: bool = True) -> Column:
    """array<double> -> (x / 255 if any is over 1 and the range is 0..1, - mean, / std); flip reverses the channels."""
    b = F.reverse(bands) if flip else bands
    scaled = F.when(F.array_max(b) > 1, F.transform(b, lambda x: x / 255.0)).otherwise(b) if unit_range else b
    centred = F.zip_with(scaled, F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return F.zip_with(centred, F.array(*map(F.lit, std)), lambda x, s: x / s)


def stack(pixels: DataFrame, source: str, value: str, keys: list[str], sources: list[str]) -> DataFrame:
    """Long (keys, source, value) -> one column per source, in one shuffle; pixels that lack a source are left out."""
    wide = pixels.groupBy(*keys).agg(*[F.max(F.when(F.col(source) == s, F.col(value))).alias(s) for s in sorted(sources)], F.count_distinct(F.when(F.col(source).isin(sources), F.col(source))).alias("_n"))
    return wide.where(F.col("_n") == len(sources)).drop("_n")


def channel_offsets(df: DataFrame, name: str = "name", channels: str = "channels") -> DataFrame:
    order = W.orderBy(name)  # a handful of sources
    return df.withColumn("channel_offset", F.sum(channels).over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col(channels))


def mosaic(chunks: DataFrame, keys: list[str], value: str, order: str, nodata: float = 0) -> DataFrame:
    """The value of the last file in order that is not nodata."""
    return chunks.where((F.col(value) != nodata) & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys).agg(F.max_by(value, order).alias(value))


def channel_histogram(df: DataFrame, channel: str, value: str, bins: int = 10) -> DataFrame:
    """channel, bin (from 0), n: equal widths between the channel's least and largest value, the last bin closed."""
    ends = df.groupBy(channel).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    at = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) * bins / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo"))), F.lit(bins - 1)))
    return df.join(ends, channel).groupBy(channel, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def check_int16(df: DataFrame, cols: list[str]) -> DataFrame:
    """The largest value of the first three columns; fails from 2**15 on."""
    top = df.agg(F.max(F.greatest(*cols[:3])).alias("largest"))
    return top.where(F.when(F.col("largest") < 2**15, True).otherwise(F.raise_error(F.lit("values do not fit 16 bits")).cast("boolean")))


def check_mask(df: DataFrame, mask: str = "mask") -> DataFrame:
    """df; fails on a row whose mask holds more than 1."""
    return df.where(F.when(F.array_max(mask) <= 1, True).otherwise(F.raise_error(F.lit("mask values over 1")).cast("boolean")))
