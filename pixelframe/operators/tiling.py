"""Tiles and patches by integer arithmetic, filters, augmentation and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def retile(pixels: DataFrame, size: tuple[int, int] = (256, 256), overlap: int = 25) -> DataFrame:
    """pixels with row, col (tile) and ty, tx (place in the tile), once for each tile that holds the pixel; edge tiles
    are partial. size is (height, width)."""

    def tiles(c: str, n: int) -> Column:
        step = n - overlap
        return F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(c) - n + 1) / step).cast("int")), F.floor(F.col(c) / step).cast("int")))

    df = pixels.withColumn("row", tiles("y", size[0])).withColumn("col", tiles("x", size[1]))
    return df.withColumn("ty", F.col("y") - F.col("row") * (size[0] - overlap)).withColumn("tx", F.col("x") - F.col("col") * (size[1] - overlap))


def tile_stats(tiles: DataFrame, keys: list[str], nodata: Column) -> DataFrame:
    return tiles.groupBy(*keys, "row", "col").agg((F.max("ty") + 1).alias("h"), (F.max("tx") + 1).alias("w"), F.avg(nodata.cast("double")).alias("nodata"))


def tile_filter(stats: DataFrame, size: tuple[int, int], max_nodata: float = 0.5) -> DataFrame:
    """Whole tiles whose nodata share is not over the limit."""
    return stats.where((F.col("nodata") <= max_nodata) & (F.col("h") == size[0]) & (F.col("w") == size[1]))


def patch_origins(scenes: DataFrame, size: int, stride: int | None = None) -> DataFrame:
    """scenes with height, width -> y_i, x_i: 0, stride, ... below height - size (the last fitting one is left out)."""
    stride = stride or size // 2
    at = lambda c: F.explode(F.filter(F.sequence(F.lit(0), F.greatest(F.col(c) - size, F.lit(0)), F.lit(stride)), lambda v: v < F.col(c) - size))
    return scenes.withColumn("y_i", at("height")).withColumn("x_i", at("width"))


def patches(pixels: DataFrame, keys: list[str], origins: DataFrame, size: int, nodata: Column, max_nodata: float = 0.0) -> DataFrame:
    """keys, y_i, x_i, n, nodata of the patches within the limit; a pixel finds its patches by arithmetic on the stride,
    through an equi-join on blocks of the patch size."""
    o = origins.select(*keys, "y_i", "x_i", F.explode(F.sequence(F.floor(F.col("y_i") / size), F.floor((F.col("y_i") + size - 1) / size))).alias("_by"))
    o = o.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("x_i") / size), F.floor((F.col("x_i") + size - 1) / size))))
    p = pixels.withColumn("_by", F.floor(F.col("y") / size)).withColumn("_bx", F.floor(F.col("x") / size)).withColumn("_nod", nodata.cast("double"))
    m = p.join(o, [*keys, "_by", "_bx"]).where(f"y >= y_i and y < y_i + {size} and x >= x_i and x < x_i + {size}")
    return m.groupBy(*keys, "y_i", "x_i").agg(F.count("*").alias("n"), F.avg("_nod").alias("nodata")).where(F.col("nodata") <= max_nodata)


def positive_tiles(tiles: DataFrame, mask: str = "mask") -> DataFrame:
    return tiles.where(F.exists(mask, lambda v: v > 0))


def pick_tiles(tiles: DataFrame, picks: dict, scene: str = "scene_id", index: str = "tile_idx") -> DataFrame:
    """The named tiles with name scene-i; picks is a short list given by the caller."""
    pairs = [(s, int(i)) for s, ids in picks.items() for i in ids]
    kind = dict(tiles.dtypes)[scene]
    few = tiles.sparkSession.createDataFrame(pairs, f"{scene} {kind}, {index} int")
    return tiles.join(F.broadcast(few), [scene, index]).withColumn("tile_name", F.concat_ws("-", F.col(scene).cast("string"), F.col(index).cast("string")))


def dense_index(tiles: DataFrame, scene: str, order: list[str]) -> DataFrame:
    return tiles.withColumn("tile_idx", F.row_number().over(W.partitionBy(scene).orderBy(*order)) - 1)


def batches(tiles: DataFrame, batch_size: int, order: list[str], scene: str = "scene_id", shuffle: bool = False, seed: int = 0) -> DataFrame:
    """batch_id within scene: tiles in order, or in an order by hash if shuffled."""
    by = [F.xxhash64(*order, F.lit(seed)), *order] if shuffle else order
    return tiles.withColumn("batch_id", F.floor((F.row_number().over(W.partitionBy(scene).orderBy(*by)) - 1) / batch_size).cast("int"))


def align_parts(parts: list[DataFrame], key: str = "file_name") -> DataFrame:
    """Parts joined on their file name; the first one names the files, a missing partner fails."""
    out = parts[0]
    for i, p in enumerate(parts[1:], 1):
        out = out.join(p.withColumn(f"_has{i}", F.lit(True)), key, "left")
        out = out.where(F.when(F.col(f"_has{i}"), True).otherwise(F.raise_error(F.concat(F.lit("missing part: "), F.col(key))).cast("boolean"))).drop(f"_has{i}")
    return out


def permute(tile: Column, size: int, flip_y: Column, flip_x: Column, transpose: Column) -> Column:
    """A size x size tile in an array, turned: out[y, x] = in[y', x'], flips after the transposition."""

    def at(i: Column) -> Column:
        y, x = F.floor(i / size).cast("int"), (i % size).cast("int")
        y, x = F.when(flip_y, size - 1 - y).otherwise(y), F.when(flip_x, size - 1 - x).otherwise(x)
        a, b = F.when(transpose, x).otherwise(y), F.when(transpose, y).otherwise(x)
        return F.get(tile, a * size + b)

    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), at)


def dihedral(tiles: DataFrame, col: str, size: int) -> DataFrame:
    """Each tile in its eight turns: op = flip_x + 2 * flip_y + 4 * transpose."""
    bit = lambda k: F.col("op").bitwiseAND(F.lit(k)) > 0
    return tiles.withColumn("op", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn(col, permute(F.col(col), size, bit(2), bit(1), bit(4)))


def blur(tile: Column, n: int) -> Column:
    """Mean of the 3 x 3 square around each pixel; beyond the edge the tile is mirrored at its outermost pixels."""
    inside = lambda v: F.when(v < 0, -v).when(v >= n, 2 * n - 2 - v).otherwise(v)

    def at(v: Column, i: Column) -> Column:
        y, x = F.floor(i / n).cast("int"), (i % n).cast("int")
        near = [F.get(tile, (inside(y + a) * n + inside(x + b)).cast("int")) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        return (sum(near[1:], near[0]) / 9).cast("float")

    return F.transform(tile, at)


def join_sources(tiles: DataFrame, aux: dict[str, DataFrame], keys: tuple = ("scene_id", "row", "col")) -> DataFrame:
    """Tiles with the arrays of further sources (keys, array) of the same scene, row and column, each as a column of its name;
    a tile that lacks one fails."""
    out = tiles
    for name, df in aux.items():
        out = out.join(df.select(*keys, F.col(df.columns[-1]).alias(name), F.lit(True).alias("_there")), list(keys), "left")
        missing = F.raise_error(F.lit(f"tile without {name}")).cast("boolean")
        out = out.where(F.when(F.col("_there"), True).otherwise(missing)).drop("_there")
    return out


def tile_dataset(parts: list[DataFrame], batch_size: int, order: list[str], transform=None, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """Tiles of several scenes as one set: put together, changed by transform (a function of a table) and dealt into batches by
    scene."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return batches(out if transform is None else transform(out), batch_size, order, shuffle=shuffle, seed=seed)


#: Augmentations by name; each takes (tile, random number in 0..1, size).
AUGMENTATIONS = {
    "HorizontalFlip": lambda t, r, n: permute(t, n, F.lit(False), r < 0.5, F.lit(False)),
    "VerticalFlip": lambda t, r, n: permute(t, n, r < 0.5, F.lit(False), F.lit(False)),
    "RandomRotate90": lambda t, r, n: permute(t, n, (r >= 0.25) & (r < 0.75), r >= 0.5, ((r >= 0.25) & (r < 0.5)) | (r >= 0.75)),
    "RandomBrightnessContrast": lambda t, r, n: F.transform(t, lambda v: (v * (0.8 + 0.4 * r) + 0.2 * (r - 0.5)).cast("float")),
    "MultiplicativeNoise": lambda t, r, n: F.transform(t, lambda v: (v * (0.9 + 0.2 * r)).cast("float")),
    "Blur": lambda t, r, n: blur(t, n),
}
GEOMETRY = ("HorizontalFlip", "VerticalFlip", "RandomRotate90")


def augment(tiles: DataFrame, types: list[str], size: int, keys: list[str], image: str = "img", mask: str = "mask", n: int = 8, seed: int = 0) -> DataFrame:
    """Each tile n times; each operation draws its number from the md5 of tile, copy, name and seed, so that image and
    mask get the same geometry."""
    df = tiles.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for name in types:
        drawn = F.md5(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (*keys, "copy")], F.lit(name), F.lit(str(seed))).cast("binary"))
        r = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
        df = df.withColumn("_r", r).withColumn(image, AUGMENTATIONS[name](F.col(image), F.col("_r"), size))
        if name in GEOMETRY:
            df = df.withColumn(mask, AUGMENTATIONS[name](F.col(mask), F.col("_r"), size))
    return df.drop("_r")
