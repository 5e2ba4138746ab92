"""Incremental scene intake and running meters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T


#: Folders of the table of what has been taken in.
PARTS = 64


def incremental_scenes(spark: SparkSession, path: str, schema, process: Callable[[DataFrame, int], None], checkpoint: str, key: str = "name"):
    """Scenes that arrive under path are handed to process(batch, number) once each. What has been taken in is a table beside
    the checkpoint, dealt by a hash of the key into PARTS folders: a batch opens those that its own keys fall in. A replayed
    batch finds the same scenes new, and memory does not grow with them. Runs over what is there and ends."""
    seen = f"{checkpoint}/taken"
    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")

    def take(batch: DataFrame, number: int) -> None:
        kind = batch.schema[key].dataType.simpleString()
        session = batch.sparkSession
        batch.select(key).limit(0).write.mode("ignore").parquet(f"{seen}/part=-1/batch=-1")
        taken = session.read.schema(f"{key} {kind}, part int, batch long").option("basePath", seen).parquet(seen)
        touched = [r["part"] for r in batch.select(part).distinct().collect()]  # at most PARTS
        old = taken.where(F.col("part").isin(touched) & (F.col("batch") < number)).select(key)
        new = batch.select(key).distinct().join(old, key, "left_anti")
        dealt = new.select(key, part, F.lit(number).cast("long").alias("batch")).repartition(min(len(touched), PARTS) or 1, "part")
        dealt.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("part", "batch").parquet(seen)
        now = session.read.schema(f"{key} {kind}, part int, batch long").option("basePath", seen).parquet(seen).where(F.col("part").isin(touched) & (F.col("batch") == number)).select(key)
        process(batch.dropDuplicates([key]).join(now, key, "left_semi"), number)

    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{checkpoint}/offsets").trigger(availableNow=True).start()


def meter_parts(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean and squared deviations from it: the state of a running mean and deviation, batch or stream. Spark merges
    them without loss for large means."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


#: Rows of a block of running_parts, and how many rows, or sums of them, are added one after the other.
BLOCK, FAN = 4096, 16


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """States (count, sum, mean, squared deviations) of rows and of those after them -> the state of both."""
    n = a[0] + b[0]
    some, delta = np.where(n == 0, 1.0, n), b[2] - a[2]
    both = np.stack([n, a[1] + b[1], (b[0] * b[2] + a[0] * a[2]) / some, b[3] + a[3] + delta * delta * b[0] * a[0] / some])
    return np.where(a[0] == 0, b, np.where(b[0] == 0, a, both))


def _dealt(x: np.ndarray) -> np.ndarray:
    """4 x n states as 4 x groups x FAN, empty ones at the end."""
    return np.pad(x, ((0, 0), (0, -x.shape[1] % FAN))).reshape(4, -1, FAN)


def _summed(x: np.ndarray) -> np.ndarray:
    """The state of each group of FAN."""
    groups, out = _dealt(x), np.zeros((4, -(-x.shape[1] // FAN)))
    for j in range(FAN):
        out = _merged(out, groups[:, :, j])
    return out


def _running(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The state of start (4 x 1) and of x up to each of its columns: a group begins with what the groups before it add up to,
    and a whole group counts as its sum. So errors do not grow with the number of rows."""
    groups, whole = _dealt(x), x.shape[1] // FAN
    ends = _running(_summed(x), start) if whole else np.empty((4, 0))
    state, out = np.concatenate([start, ends], axis=1)[:, : groups.shape[1]], np.empty_like(groups)
    for j in range(FAN):
        state = out[:, :, j] = _merged(state, groups[:, :, j])
    out[:, :whole, -1] = ends[:, :whole]
    return out.reshape(4, -1)[:, : x.shape[1]]


def running_parts(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, order, rows, and n, mean, m2 as in meter_parts, of each row and the rows of its keys before it. A window numbers the
    rows; blocks of BLOCK rows are summed up by themselves, one row for each block is summed up for its keys, and each block
    goes on from there."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    rows = df.select(*keys, order, F.col(value).cast("double").alias("_v"), at.cast("long").alias("rows")).withColumn("_block", F.floor((F.col("rows") - 1) / BLOCK))
    state = ["_n", "_sum", "_mean", "_m2"]
    names = [*keys, "_block", *state]
    held = T.StructType([rows.schema[k] for k in [*keys, "_block"]] + [T.StructField(c, T.DoubleType()) for c in state])

    def states(t: pa.Table) -> tuple[pa.Table, np.ndarray]:
        """The rows in order, and a state of each."""
        t = t.sort_by("rows")
        v = t.column("_v")
        there = v.is_valid().to_numpy()
        x = np.where(there, v.fill_null(0.0).to_numpy(), 0.0)
        return t, np.stack([there.astype(float), x, x, np.zeros(len(x))])

    def block(t: pa.Table) -> pa.Table:
        t, x = states(t)
        while x.shape[1] > 1:
            x = _summed(x)
        return pa.table([*[t.column(c).slice(0, 1) for c in names[: -len(state)]], *[pa.array(c) for c in x]], names)

    def ahead(t: pa.Table) -> pa.Table:
        """What each block begins with and ends with."""
        t = t.sort_by("_block")
        ends = _running(np.stack([t.column(c).to_numpy() for c in state]), np.zeros((4, 1)))
        starts = np.concatenate([np.zeros((4, 1)), ends[:, :-1]], axis=1)
        return pa.table([*[t.column(c) for c in names[: -len(state)]], *[pa.array(c) for c in (*starts, *ends)]], [*names, *[f"{c}_end" for c in state]])

    def fill(t: pa.Table, around: pa.Table) -> pa.Table:
        t, x = states(t)
        start, end = (np.array([[around.column(c + after)[0].as_py()] for c in state]) for after in ("", "_end"))
        out = _running(x, start)
        out[:, -1:] = end
        n = out[0].astype(np.int64)
        mean = pa.array(out[1] / np.maximum(n, 1), mask=n == 0)
        return pa.table([*[t.column(c) for c in [*keys, order, "rows"]], pa.array(n), mean, pa.array(out[3], mask=n == 0)], [*keys, order, "rows", "n", "mean", "m2"])

    per = [*keys, "_block"]
    sums = rows.groupBy(*per).applyInArrow(block, held)
    ends = sums.groupBy(*keys).applyInArrow(ahead, T.StructType([*held.fields, *[T.StructField(f"{c}_end", T.DoubleType()) for c in state]]))
    full = T.StructType([rows.schema[c] for c in [*keys, order, "rows"]]).add("n", "long").add("mean", "double").add("m2", "double")
    return rows.groupBy(*per).cogroup(ends.groupBy(*per)).applyInArrow(fill, full)


def meter_value(parts: DataFrame) -> DataFrame:
    """mean and sample deviation: NaN without values, infinite deviation for one."""
    n, nan = F.col("n"), F.lit(float("nan"))
    std = F.when(n == 0, nan).when(n == 1, F.lit(float("inf"))).otherwise(F.sqrt(F.col("m2") / (n - 1)))
    return parts.withColumn("mean", F.when(n == 0, nan).otherwise(F.col("mean"))).withColumn("std", std)


def running_meter(stream: DataFrame, keys: list[str], value: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """meter_parts as a stream in update mode; sink gets the changed keys of each batch."""
    return meter_parts(stream, keys, value).writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulate(stream: DataFrame, keys: list[str], sums: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str, ts: str = "ts", order: str = "ts", reset: str | None = None, delay: str = "1 hour"):
    """Sums of each key as state of its own, with three operations: update (every row adds its numbers), reset (a row
    whose column reset is true starts from zero again; its own numbers do not count) and compute (each batch hands the
    keys that it changed to sink: keys, sums, n, closed). A key closes when the watermark (delay behind the latest ts) has passed its last row:
    a timer hands out its sums once more, with closed true, and forgets it. Rows of a closed key come too late and are
    left out. State and timers survive a stop in the checkpoint. Rows of a batch count in the order of their column order.
    Null numbers add nothing; null keys are a key; rows without a ts are left out. State is one row of numbers for each open key."""
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    out = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *[f"{c} long" for c in sums], "n long, closed boolean"])
    hold = ", ".join([*[f"{c} long" for c in sums], "n long, last long"])
    late = round(pd.Timedelta(delay).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        total = list(state.get) if state.exists else [0] * (len(sums) + 2)
        row = lambda closed: pd.DataFrame([[*key, *total[:-1], closed]], columns=[*keys, *sums, "n", "closed"])
        if state.hasTimedOut:
            state.remove()
            yield row(True)
            return
        df = pd.concat(list(parts)).sort_values(order, kind="stable", ignore_index=True)
        last = df["_ms"].max()
        if reset is not None and (again := df[reset].eq(True)).any():
            df = df.iloc[int(df.index[again][-1]) + 1 :]
            total = [0] * (len(sums) + 1) + total[-1:]
        for i, c in enumerate(sums):
            total[i] += int(df[c].fillna(0).sum())
        total[-2] += len(df)
        total[-1] = max(total[-1], int(last))
        state.update(tuple(total))
        state.setTimeoutTimestamp(max(total[-1] + late, state.getCurrentWatermarkMs() + 1))
        yield row(False)

    rows = stream.where(F.col(ts).isNotNull()).withWatermark(ts, delay).withColumn("_ms", F.unix_millis(ts)).groupBy(*keys).applyInPandasWithState(step, out, hold, "update", "EventTimeTimeout")
    return rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
