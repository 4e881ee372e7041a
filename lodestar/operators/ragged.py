"""Ragged and sparse tensors as rows: (batch, position, features) and (batch, x, y, z, features).

Row order carries no meaning, so contiguity of batches and layouts of offsets are not kept;
where the offsets themselves are wanted they come from counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.flow import bound
from lodestar.operators.shard import global_index, running_sum

XYZ = ("x", "y", "z")


def cell(axis: str | Column, factor: int) -> Column:
    """Floor division; integer `div` would truncate towards zero."""
    return F.floor((F.col(axis) if isinstance(axis, str) else axis) / factor).cast("int")


def pooled(df: DataFrame, factor: int, values: list[str], how: str = "mean", batch: str = "batch_id") -> DataFrame:
    """Features of a coarser grid: mean or max over the children of each cell."""
    agg = {"mean": F.avg, "max": F.max}[how]
    keys = [F.col(batch), *(cell(a, factor).alias(a) for a in XYZ)]
    return df.groupBy(*keys).agg(*(agg(v).alias(v) for v in values))


def pooled_arrays(df: DataFrame, keys: list[str], feats: str, how: str = "mean") -> DataFrame:
    """Element-wise mean, max, sum or product of equally long feature arrays per group.

    Arrays are taken apart by position, so that partial results combine before the shuffle.
    """
    agg = {"mean": F.avg, "max": F.max, "sum": F.sum, "prod": F.product}[how]
    parts = df.select(*keys, F.posexplode(feats).alias("_i", "_v")).groupBy(*keys, "_i").agg(agg(F.col("_v").cast("double")).alias("_v"))
    rows = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_a"))
    return rows.select(*keys, F.transform("_a", lambda e: e["_v"]).alias(feats))


def distinct_cells(df: DataFrame, factor: int, batch: str = "batch_id") -> DataFrame:
    return df.select(batch, *(cell(a, factor).alias(a) for a in XYZ)).distinct()


def linear_code(size: int) -> Column:
    """(b, x, y, z) as one number, in the order in which sorted distinct cells are listed."""
    return ((F.col("batch_id").cast("bigint") * size + F.col("x")) * size + F.col("y")) * size + F.col("z")


def from_linear_code(code: Column, size: int) -> dict[str, Column]:
    return {
        "batch_id": F.floor(code / size**3).cast("int"), "x": F.pmod(F.floor(code / size**2), F.lit(size)).cast("int"),
        "y": F.pmod(F.floor(code / size), F.lit(size)).cast("int"), "z": F.pmod(code, F.lit(size)).cast("int"),
    }


def reduced(df: DataFrame, value: str, batch: str = "batch_id", batches: DataFrame | None = None) -> DataFrame:
    """Per batch mean, sum, product and population standard deviation.

    With `batches`, batches without rows are listed too: sum 0, product 1, mean and std null.
    """
    out = df.groupBy(batch).agg(
        F.avg(value).alias("mean"), F.sum(value).alias("sum"), F.product(value).alias("prod"), F.stddev_pop(value).alias("std_pop")
    )
    if batches is None:
        return out
    return batches.select(batch).join(out, batch, "left").fillna({"sum": 0.0, "prod": 1.0})


def layout(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """batch, start, stop: where each batch would lie in a packed array. One row per batch."""
    n = df.groupBy(batch).agg(F.count("*").alias("n"))
    return running_sum(n, [F.col(batch)], "n", "stop").select(batch, (F.col("stop") - F.col("n")).alias("start"), "stop")


def padded(df: DataFrame, batch: str, position: str, value: str, width: int | None = None) -> DataFrame:
    """batch, slot, value, mask: `width` slots per batch, filled in position order; without a width as many as the longest batch has."""
    if width is None:
        width = df.groupBy(batch).agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if not width:
        return df.select(batch, F.lit(0).alias("slot"), value, F.lit(False).alias("mask")).where("false")
    slot = F.row_number().over(Window.partitionBy(batch).orderBy(position)) - 1
    rows = df.withColumn("slot", slot.cast("int")).where(F.col("slot") < width).select(batch, "slot", value)
    slots = df.select(batch).distinct().withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return slots.join(rows.withColumn("mask", F.lit(True)), [batch, "slot"], "left").withColumn("mask", F.coalesce("mask", F.lit(False)))


def extent(df: DataFrame) -> DataFrame:
    return df.agg(*((F.max(a) + 1).alias(f"n{a}") for a in XYZ))


def slot_of() -> Column:
    """Which of its parent's eight children a voxel is: sx + 2 sy + 4 sz."""
    return sum((F.pmod(F.col(a), F.lit(2)) * (1 << i) for i, a in enumerate(XYZ)), F.lit(0)).cast("int")


def subdivision(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per parent cell an 8-bit mask of the children that are there."""
    return df.select(batch, *(cell(a, 2).alias(a) for a in XYZ), F.call_function("shiftleft", F.lit(1), slot_of()).alias("bit")).groupBy(batch, *XYZ).agg(
        F.bit_or("bit").cast("int").alias("mask")
    )


def subdivided(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Parents back to children: coordinates 2c + bit of the slot, for the mask's bits."""
    rows = df.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(7)))).where(f"({mask} >> _slot) & 1 = 1")
    return rows.withColumns({a: F.col(a) * 2 + F.expr(f"(_slot >> {i}) & 1") for i, a in enumerate(XYZ)}).drop("_slot")


def space_to_channel(df: DataFrame, feats: str, channels: int, batch: str = "batch_id") -> DataFrame:
    """Eight children into one row; absent children are zeros. Slots follow slot_of()."""
    zero = F.array(*[F.lit(0.0)] * channels)
    per_slot = [F.coalesce(F.first(F.when(F.col("_slot") == s, F.col(feats)), ignorenulls=True), zero) for s in range(8)]
    rows = df.withColumn("_slot", slot_of())
    return rows.groupBy(F.col(batch), *(cell(a, 2).alias(a) for a in XYZ)).agg(F.flatten(F.array(*per_slot)).alias(feats))


def channel_to_space(df: DataFrame, feats: str, channels: int, mask: str | None = None) -> DataFrame:
    """The inverse: one row per slot (of the mask, if given)."""
    rows = df.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(7))))
    if mask:
        rows = rows.where(f"({mask} >> _slot) & 1 = 1")
    return rows.withColumns(
        {feats: F.slice(feats, F.col("_slot") * channels + 1, channels), **{a: F.col(a) * 2 + F.expr(f"(_slot >> {i}) & 1") for i, a in enumerate(XYZ)}}
    ).drop("_slot")


def window_codes(df: DataFrame, window: int, shift: int, per_axis: int, batch: str = "batch_id") -> DataFrame:
    """Adds the code of the shifted attention window that a voxel falls into."""
    w = {a: F.floor((F.col(a) + shift) / window) for a in XYZ}
    code = ((F.col(batch).cast("bigint") * per_axis + w["x"]) * per_axis + w["y"]) * per_axis + w["z"]
    return df.withColumn("window", code.cast("bigint"))


def window_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy("window").agg(F.count("*").alias("n"))


def concat_batches(frames: list[DataFrame], batches: list[int], batch: str = "batch_id") -> DataFrame:
    """Tensors stacked on the batch axis: each one's ids move up by the batches before it."""
    out, offset = None, 0
    for df, n in zip(frames, batches):
        moved = df.withColumn(batch, F.col(batch) + offset)
        out, offset = moved if out is None else out.unionByName(moved), offset + n
    return out


def concat_features(left: DataFrame, right: DataFrame, on: list[str], feats: str) -> DataFrame:
    r = right.select(*on, F.col(feats).alias("_more"))
    return left.join(r, on).withColumn(feats, F.concat(feats, "_more")).drop("_more")


def select_batches(df: DataFrame, wanted: list[int], batch: str = "batch_id") -> DataFrame:
    """Chosen batches, numbered in the order of the list; a batch named twice comes twice."""
    places = F.array(*(F.struct(F.lit(w).alias("from"), F.lit(i).alias("to")) for i, w in enumerate(wanted)))
    return df.withColumn("_p", F.explode(F.filter(places, lambda p: p["from"] == F.col(batch)))).withColumn(batch, F.col("_p.to")).drop("_p")


def full_grid(spark, sizes: tuple[int, int, int]) -> DataFrame:
    rows = spark.range(1)
    for a, n in zip(XYZ, sizes):
        rows = rows.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.select(*XYZ)


def dense(sparse: DataFrame, sizes: tuple[int, int, int], value: str, batch: str = "batch_id") -> DataFrame:
    """All cells of each batch's grid with the sparse table's value, 0 elsewhere."""
    grid = sparse.select(batch).distinct()
    for a, n in zip(XYZ, sizes):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(sparse.select(batch, *XYZ, value), [batch, *XYZ], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def gathered(dense_table: DataFrame, at: DataFrame, on: list[str]) -> DataFrame:
    """Values of a dense table at sparse coordinates."""
    return at.select(on).join(dense_table, on)


def neighbours(df: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pairs of occupied cells that touch (27 offsets, the cell itself included).

    Each cell asks for 27 coordinates by an equi-join: 27 n rows whatever the density.
    """
    steps = F.sequence(F.lit(-1), F.lit(1))
    asked = df.select(batch, *XYZ)
    for a in XYZ:
        asked = asked.withColumn(f"d{a}", F.explode(steps))
    asked = asked.select(batch, *(F.col(a).alias(f"from_{a}") for a in XYZ), *((F.col(a) + F.col(f"d{a}")).alias(a) for a in XYZ))
    return asked.join(df.select(batch, *XYZ), [batch, *XYZ])


def broadcast_add(df: DataFrame, per_batch: DataFrame, feats: str, vector: str, batch: str) -> DataFrame:
    """Adds each batch's vector to its rows; join strategy is left to statistics."""
    return df.join(per_batch.select(batch, F.col(vector).alias("_v")), batch).withColumn(feats, F.zip_with(feats, "_v", lambda a, b: a + b)).drop("_v")


def mse_per_instance(df: DataFrame, instance: str, a: str, b: str) -> DataFrame:
    """Mean squared difference over all components of an instance's rows; partial sums combine before the shuffle."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return df.groupBy(instance).agg((F.sum(apart) / F.sum(F.size(a))).alias("mse"))


def corners(faces: DataFrame, vertices: DataFrame, face: list[str]) -> DataFrame:
    """face, corner and the vertex's columns, for corners v0, v1, v2; corners without a vertex are left out."""
    asked = faces.select(*face, F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "v_idx"))
    return asked.join(vertices, "v_idx").drop("v_idx")


def standardised(feats: str | Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(feats, mean, lambda x, m: x - m), std, lambda x, s: x / s)


def unstandardised(feats: str | Column, mean: Column, std: Column) -> Column:
    return F.zip_with(F.zip_with(feats, std, lambda x, s: x * s), mean, lambda x, m: x + m)


def layer_norm(feats: Column, eps: float = 1e-5) -> Column:
    """(x - mean) / sqrt(population variance + eps) within each row."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scaled = lambda c: bound(F.sqrt(total(F.transform(c, lambda x: x * x)) / F.size(c) + eps), lambda d: F.transform(c, lambda x: x / d))
    centred = lambda v: bound(total(v) / F.size(v), lambda mean: F.transform(v, lambda x: x - mean))
    return bound(F.transform(feats, lambda x: x.cast("double")), lambda v: bound(centred(v), scaled))


def budget_search(cells: DataFrame, low: int, high: int, budget: int, step: int = 128, floor: int = 1024) -> DataFrame:
    """The highest resolution whose distinct quantised cells stay below the budget.

    All candidates are counted in one pass; if none fits, the floor is taken.
    """
    g = F.col("resolution") / 16 - 1
    candidates = cells.withColumn("resolution", F.explode(F.sequence(F.lit(high), F.lit(floor), F.lit(-step))))
    quant = [F.rint((F.col(a) + 0.5) / low * g).cast("int").alias(a) for a in XYZ]
    counts = candidates.select("batch_id", "resolution", *quant).distinct().groupBy("resolution").agg(F.count("*").alias("n"))
    fits = (F.col("n") < budget) | (F.col("resolution") == floor)
    return counts.where(fits).agg(F.max(F.struct("resolution", "n")).alias("best")).select("best.*")


def pixel_unshuffled(df: DataFrame, factor: int, channel: str = "c") -> DataFrame:
    """Moves each factor^3 block of cells into channels: c' = c factor^3 + the place in the block."""
    place = (F.pmod(F.col("x"), F.lit(factor)) * factor + F.pmod(F.col("y"), F.lit(factor))) * factor + F.pmod(F.col("z"), F.lit(factor))
    moved = df.withColumn(channel, (F.col(channel) * factor**3 + place).cast("int"))
    return moved.withColumns({a: cell(a, factor) for a in XYZ})


def pixel_shuffled(df: DataFrame, factor: int, channel: str = "c") -> DataFrame:
    """The inverse: channels back to cells of a grid `factor` times as fine."""
    place = F.pmod(F.col(channel), F.lit(factor**3))
    steps = {"x": F.floor(place / factor**2), "y": F.pmod(F.floor(place / factor), F.lit(factor)), "z": F.pmod(place, F.lit(factor))}
    fine = {a: (F.col(a) * factor + s).cast("int") for a, s in steps.items()}
    return df.withColumns({**fine, channel: F.floor(F.col(channel) / factor**3).cast("int")})


def patches(df: DataFrame, size: int) -> DataFrame:
    """Adds the patch of each cell and the cell's place in it."""
    place = (F.pmod(F.col("x"), F.lit(size)) * size + F.pmod(F.col("y"), F.lit(size))) * size + F.pmod(F.col("z"), F.lit(size))
    return df.withColumns({**{f"p{a}": cell(a, size) for a in XYZ}, "place": place.cast("int")})


def collated(samples: DataFrame, sample: str, batch: str = "batch_id") -> DataFrame:
    """Numbers the samples of one batch 0, 1, ... in the order of their keys.

    The keys of a batch are few: they are numbered on their own and joined back.
    """
    numbers = global_index(samples.select(sample).distinct(), [F.col(sample)], batch)
    return samples.join(numbers.withColumn(batch, F.col(batch).cast("int")), sample)


def attention(df: DataFrame, batch: str, token: str, q: str, k: str, v: str) -> DataFrame:
    """Softmax attention within each batch; batches are short sequences, and meet by an equi-join.

    The greatest score is taken off before `exp`, as is usual, which changes nothing but overflow.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    left, right = df.select(batch, F.col(token).alias("_t"), F.col(q).alias("_q")), df.select(batch, F.col(k).alias("_k"), F.col(v).alias("_v"))
    scored = left.join(right, batch).withColumn("_s", dot("_q", "_k") / F.sqrt(F.size("_q").cast("double")))
    row = Window.partitionBy(batch, "_t")
    weighed = scored.withColumn("_w", F.exp(F.col("_s") - F.max("_s").over(row)))
    parts = weighed.select(batch, "_t", "_w", F.posexplode("_v").alias("_i", "_x")).groupBy(batch, "_t", "_i")
    cells = parts.agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("_y"))
    out = cells.groupBy(batch, F.col("_t").alias(token)).agg(F.array_sort(F.collect_list(F.struct("_i", "_y"))).alias("_a"))
    return out.select(batch, token, F.transform("_a", lambda e: e["_y"]).alias("out"))


def from_dense(df: DataFrame, keys: list[str], values: str, width: int) -> DataFrame:
    """keys, y, x, value: the places of a flat row-major image that aren't zero."""
    rows = df.select(*keys, F.posexplode(values).alias("_i", "value")).where(F.col("value") != 0)
    return rows.select(*keys, F.floor(F.col("_i") / width).cast("int").alias("y"), (F.col("_i") % width).alias("x"), "value")


def unpatched(df: DataFrame, size: int) -> DataFrame:
    """The inverse of `patches`: cells from patch and place."""
    place = F.col("place")
    steps = {"x": F.floor(place / size**2), "y": F.pmod(F.floor(place / size), F.lit(size)), "z": F.pmod(place, F.lit(size))}
    return df.withColumns({a: (F.col(f"p{a}") * size + s).cast("int") for a, s in steps.items()}).drop("px", "py", "pz", "place")


def group_norm(df: DataFrame, batch: str, feats: str, channels: int, groups: int, eps: float = 1e-5) -> DataFrame:
    """Features standardised by the mean and variance of their batch and channel group.

    Moments combine before the shuffle; only one row per batch is joined back.
    """
    per = channels // groups
    values = df.select(batch, F.posexplode(feats).alias("_i", "_v")).select(batch, F.floor(F.col("_i") / per).alias("_g"), F.col("_v").cast("double").alias("_v"))
    moments = values.groupBy(batch, "_g").agg(F.avg("_v").alias("mean"), F.var_pop("_v").alias("var"))
    listed = moments.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct("_g", "mean", "var"))).alias("_m"))
    group = lambda i: F.get("_m", F.floor(i / per).cast("int"))
    scaled = F.transform(feats, lambda x, i: (x.cast("double") - group(i)["mean"]) / F.sqrt(group(i)["var"] + eps))
    return df.join(listed, batch).withColumn(feats, scaled).drop("_m")


def convolved(df: DataFrame, value: str, kernel: Column, batch: str = "batch_id") -> DataFrame:
    """Per occupied cell the sum over its 27 neighbours of kernel * value; kernel is of dx, dy, dz, seen from the cell.

    Each cell sends its share to 27 places, where shares combine before the shuffle; those that
    reach no occupied cell are dropped by a join on the same keys.
    """
    sent = df.select(batch, *XYZ, value)
    for a in XYZ:
        sent = sent.withColumn(f"d{a}", F.explode(F.sequence(F.lit(-1), F.lit(1))))
    share = (kernel * F.col(value)).alias("_share")
    sent = sent.select(batch, *((F.col(a) - F.col(f"d{a}")).alias(a) for a in XYZ), share)
    return sent.groupBy(batch, *XYZ).agg(F.sum("_share").alias(value)).join(df.select(batch, *XYZ), [batch, *XYZ], "left_semi")


def trilinear(points: DataFrame, cells: DataFrame, keys: list[str], batch: str, value: str) -> DataFrame:
    """keys, value: a cell attribute at points (columns batch, px, py, pz), between the centres x, y, z of eight cells.

    A corner without a cell, inside or beyond the grid, has no weight; the weights of those that are there are made to sum to
    1. A point all of whose corners that have a weight are missing has null.
    """
    low = {a: F.floor(F.col(f"p{a}")) for a in "xyz"}
    near = points.select(*keys, batch, *(c.cast("int").alias(a) for a, c in low.items()), *((F.col(f"p{a}") - c).alias(f"_w{a}") for a, c in low.items()))
    corner = F.explode(F.array(*(F.struct(*(F.lit(k >> j & 1).alias(a) for j, a in enumerate("xyz"))) for k in range(8))))
    weight = lambda a: F.when(F.col(f"_k.{a}") == 1, F.col(f"_w{a}")).otherwise(1 - F.col(f"_w{a}"))
    corners = near.withColumn("_k", corner).withColumn("_w", weight("x") * weight("y") * weight("z"))
    at = corners.select(*keys, "_w", F.col(batch).alias("_b"), *((F.col(a) + F.col(f"_k.{a}")).alias(f"_{a}") for a in "xyz"))
    there = cells.select(F.col(batch).alias("_b"), *(F.col(a).alias(f"_{a}") for a in "xyz"), F.col(value).alias("_v"))
    found = at.join(there, ["_b", "_x", "_y", "_z"], "left")
    weights = F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))
    return found.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("_v")) / F.nullif(weights, F.lit(0.0))).alias(value))


def chunks(channels: Column, n: int) -> Column:
    """An array in pieces of equal size, rounded up; the last one may be shorter, and there may be fewer than n."""
    size = F.greatest(F.ceil(F.size(channels) / n), F.lit(1))
    starts = F.when(F.size(channels) > 0, F.sequence(F.lit(1).cast("bigint"), F.size(channels).cast("bigint"), size)).otherwise(F.expr("CAST(array() AS array<bigint>)"))
    return F.transform(starts, lambda i: F.slice(channels, i.cast("int"), size.cast("int")))
