"""Boxes, slices and masks as tables of voxels: aggregations and joins by case."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .metrics import exact_percentiles
from .rows import uniform

#: Parts of image types, the preferred first.
IMAGE_TYPES = ("IP", "INPHASE", "IN_PHASE", "WATER", "W", "OUT_PHASE", "OUTPHASE", "OP", "OPP_PHASE", "FAT", "F", "M")


def mask_box(voxels: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Tight inclusive box of the foreground."""
    return voxels.groupBy(*by).agg(*[f(a).alias(f"{a}{n}") for a in axes for f, n in ((F.min, 0), (F.max, 1))])


def union_box(boxes: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return boxes.groupBy(*by).agg(*[f(f"{a}{n}").alias(f"{a}{n}") for a in axes for f, n in ((F.min, 0), (F.max, 1))])


def margin_to_px(mm: float, spacing: Column) -> Column:
    """Margin in pixels, rounded half to even; null where the spacing is 0 or unknown."""
    return F.bround(F.try_divide(F.lit(float(mm)), spacing.cast("double"))).cast("int")


def expand_box(boxes: DataFrame, margins: dict[str, Column], limits: dict[str, Column] | None = None) -> DataFrame:
    """Boxes grown by a margin per axis, and clipped to [0, limit - 1] if limits are given."""
    out = {}
    for a, m in margins.items():
        lo, hi = F.col(f"{a}0") - m, F.col(f"{a}1") + m
        out[f"{a}0"], out[f"{a}1"] = (F.greatest(F.lit(0), lo), F.least(limits[a] - 1, hi)) if limits else (lo, hi)
    return boxes.withColumns(out)


def jitter_box(boxes: DataFrame, key: str, width: Column, height: Column, shift: float = 0.1, scale: tuple[float, float] = (0.9, 1.2), seed: int = 0) -> DataFrame:
    """Boxes (x0, y0, x1, y1, inclusive) moved by up to ``shift`` of their size and scaled within ``scale``, on each axis
    by draws of its own from the seeded hash of ``key``; clipped to the image, rounded half to even, at least two wide."""
    out = {}
    for axis, extent, k in (("x", width, 0), ("y", height, 1)):
        lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
        size = (hi - lo + 1).cast("double")
        middle = lo + size / 2.0 + ((2.0 * uniform(key, seed, k) - 1.0) * shift) * size
        half = size * (scale[0] + (scale[1] - scale[0]) * uniform(key, seed, 2 + k)) / 2.0
        a = F.bround(F.greatest(F.lit(0.0), middle - half)).cast("int")
        b = F.bround(F.least((extent - 1).cast("double"), middle + half)).cast("int")
        flat = b <= a
        out[f"{axis}0"] = F.when(flat, F.greatest(F.lit(0), F.least(a, extent.cast("int") - 2))).otherwise(a)
        out[f"{axis}1"] = F.when(flat, F.least(extent.cast("int") - 1, F.greatest(F.greatest(F.lit(0), F.least(a, extent.cast("int") - 2)) + 1, b))).otherwise(b)
    return boxes.withColumns(out)


def box_iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of inclusive boxes (r0, r1, c0, c1)."""
    h = F.greatest(F.lit(0), F.least(a[1], b[1]) - F.greatest(a[0], b[0]) + 1)
    w = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[2], b[2]) + 1)
    area = lambda x: (x[1] - x[0] + 1) * (x[3] - x[2] + 1)
    return F.try_divide((h * w).cast("double"), area(a) + area(b) - h * w)


def slice_areas(voxels: DataFrame, by: list[str], axis: str) -> DataFrame:
    return voxels.groupBy(*by, F.col(axis).alias("slice")).agg(F.count("*").alias("area"))


def topk_slices(areas: DataFrame, by: list[str], k: int) -> DataFrame:
    """Largest slices of each case; ties to the higher slice."""
    return areas.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("area"), F.desc("slice")))).where(F.col("rank") <= k)


def slice_span(voxels: DataFrame, by: list[str], axis: str, most: int | None = None) -> DataFrame:
    """(slice) from the first to the last foreground slice, gaps included; at most ``most``, evenly, both ends kept."""
    ends = voxels.groupBy(*by).agg(F.min(axis).alias("_a"), F.max(axis).alias("_b"))
    every = F.sequence("_a", "_b")
    if most and most > 1:
        step = (F.col("_b") - F.col("_a")).cast("double") / (most - 1)
        some = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.col("_a") + F.bround(i * step).cast("int")))
        every = F.when(F.col("_b") - F.col("_a") + 1 > most, some).otherwise(every)
    return ends.select(*by, F.explode(every).alias("slice"))


def dice_iou(a: DataFrame, b: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """(dice, iou, n_a, n_b) of two masks per case; both empty can't occur in a voxel table."""
    one = a.select(*by, *axes).distinct().withColumn("_a", F.lit(1))
    two = b.select(*by, *axes).distinct().withColumn("_b", F.lit(1))
    g = one.join(two, [*by, *axes], "full_outer").groupBy(*by).agg(F.count("_a").alias("n_a"), F.count("_b").alias("n_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("_i"))
    both = F.col("n_a") + F.col("n_b")
    return g.select(*by, "n_a", "n_b", (2.0 * F.col("_i") / both).alias("dice"), (F.col("_i") / (both - F.col("_i")).cast("double")).alias("iou"))


def mask_filter(values: DataFrame, mask: DataFrame, by: list[str], axes: list[str], value: str, background: float = 0.0) -> DataFrame:
    inside = mask.select(*by, *axes).distinct().withColumn("_in", F.lit(True))
    return values.join(inside, [*by, *axes], "left").withColumn(value, F.when(F.col("_in"), F.col(value)).otherwise(F.lit(background))).drop("_in")


def normalize_intensity(values: DataFrame, by: list[str], value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values clipped to two percentiles of the non-zero ones and scaled to 0..1; a flat volume becomes 0."""
    q = exact_percentiles(values.where(F.col(value) != 0), by, value, {"_lo": low, "_hi": high})
    x = (F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi")) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return values.join(q, by, "left").withColumn("scaled", F.coalesce(x, F.lit(0.0))).drop("_lo", "_hi")


def volume_stats(values: DataFrame, by: list[str], value: str, inside: Column) -> DataFrame:
    fg = F.when(inside, F.col(value))
    p99 = exact_percentiles(values, by, value, {"p99": 0.99})
    return values.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.count(fg).alias("n_fg"), F.avg(fg).alias("fg_mean"), F.stddev_pop(fg).alias("fg_std")).join(p99, by, "left")


@F.pandas_udf(ArrayType(DoubleType()))
def _line_transform(places: pd.Series, squares: pd.Series, asked: pd.Series) -> pd.Series:
    """For each place asked of a line, the least of squared distance to a place of the line plus that one's own square."""
    out = []
    for p, f, q in zip(places, squares, asked, strict=True):
        step = max(1, (1 << 20) // len(p))  # a matrix of bounded size
        out.append(np.concatenate([((q[k : k + step, None] - p) ** 2 + f).min(1) for k in range(0, len(q), step)]))
    return pd.Series(out)


def nearest_distances(a: DataFrame, b: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """(by, d): distance from each distinct point of ``a`` to the nearest point of ``b`` in its case; cases without
    points of ``b`` have no rows.

    The exact separable distance transform: a pass per axis gives each line of cells, along that axis, the least squared
    distance over it, for the coordinates that points of ``a`` have. A pass shuffles lines, whose length is an image's
    extent, so no task holds a case; nothing runs before the result is asked for, and nothing stays cached.
    """
    here = a.select(*by, *[F.col(c).cast("double").alias(c) for c in axes]).distinct()
    cells = b.select(*by, *[F.col(c).cast("double").alias(c) for c in axes]).distinct().withColumn("_f", F.lit(0.0))
    for k, axis in enumerate(axes):
        others = [c for c in axes if c != axis]
        keys = [*by, *(others if k == len(axes) - 1 else [])]  # the last pass asks for the points alone
        lines = cells.groupBy(*by, *others).agg(F.collect_list(F.struct(F.col(axis).alias("p"), F.col("_f").alias("f"))).alias("_line"))
        asked = here.groupBy(*keys).agg(F.collect_set(axis).alias("_q"))
        x = lines.join(asked, keys).select(*by, *others, "_q", _line_transform(F.col("_line")["p"], F.col("_line")["f"], F.col("_q")).alias("_f"))
        cells = x.select(*by, *others, F.explode(F.arrays_zip("_q", "_f")).alias("_c")).select(*by, *others, F.col("_c._q").alias(axis), F.col("_c._f").alias("_f"))
    return cells.select(*by, F.sqrt("_f").alias("d"))


def hd95(a: DataFrame, b: DataFrame, by: list[str], axes: list[str]) -> DataFrame:
    """95th percentile of nearest distances both ways between two boundary point sets of each case."""
    both = nearest_distances(a, b, by, axes).unionByName(nearest_distances(b, a, by, axes))
    return exact_percentiles(both, by, "d", {"hd95": 0.95})


def radial_profile(points: DataFrame, by: list[str], bins: int = 36) -> DataFrame:
    """(bin, radius): outermost radius about the centroid per angle bin, over the mean; empty bins take the last
    filled one before them around the circle."""
    centre = points.groupBy(*by).agg(F.avg("x").alias("_cx"), F.avg("y").alias("_cy"))
    p = points.join(centre, by).withColumns({"_dx": F.col("x") - F.col("_cx"), "_dy": F.col("y") - F.col("_cy")})
    at = F.least(F.floor((F.atan2("_dy", "_dx") + math.pi) / (2 * math.pi) * bins), F.lit(bins - 1)).cast("int")
    r = p.groupBy(*by, at.alias("bin")).agg(F.max(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).alias("_r"))
    grid = centre.select(*by, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).join(r, [*by, "bin"], "left")
    w = Window.partitionBy(*by).orderBy("bin")
    last = F.last("_r", ignorenulls=True)
    filled = F.coalesce(last.over(w.rowsBetween(Window.unboundedPreceding, 0)), last.over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    g = grid.withColumn("_f", filled)
    return g.select(*by, "bin", (F.col("_f") / F.nullif(F.avg("_f").over(Window.partitionBy(*by)), F.lit(0.0))).alias("radius"))


def harmonic_amplitudes(profile: DataFrame, by: list[str], position: str, value: str, n: int, harmonics: list[int]) -> DataFrame:
    """(k, amplitude) of a sampled closed curve: 2/n times the size of its k-th Fourier sum."""
    x = profile.withColumn("k", F.explode(F.array(*[F.lit(k) for k in harmonics])))
    phase = F.col("k") * F.col(position) * (2 * math.pi / n)
    g = x.groupBy(*by, "k").agg(F.sum(F.col(value) * F.cos(phase)).alias("_c"), F.sum(F.col(value) * F.sin(phase)).alias("_s"))
    return g.select(*by, "k", (F.sqrt(F.col("_c") * F.col("_c") + F.col("_s") * F.col("_s")) * (2.0 / n)).alias("amplitude"))


#: Harmonics of a contour's lobes and of its jags (fixed values).
LOBES, JAGS = (3, 7), (8, 22)


def harmonic_bands(profile: DataFrame, by: list[str], position: str, value: str, n: int, bands: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """(by, a column for each band): root of the sum of squared amplitudes of the band's harmonics, from one pass over the
    samples. A band ends at the highest harmonic of ``n`` samples; one that begins beyond it is null."""
    bands = bands or {"lobe_amp": LOBES, "jag_amp": JAGS}
    wanted = sorted({k for lo, hi in bands.values() for k in range(lo, min(hi, n // 2) + 1)})
    amplitude = harmonic_amplitudes(profile, by, position, value, n, wanted)
    square = lambda lo, hi: F.sqrt(F.sum(F.when(F.col("k").between(lo, min(hi, n // 2)), F.col("amplitude") * F.col("amplitude"))))
    return amplitude.groupBy(*by).agg(*[square(lo, hi).alias(name) for name, (lo, hi) in bands.items()])


def circularity(area: Column, perimeter: Column) -> Column:
    return F.try_divide(4 * math.pi * area, perimeter * perimeter)


def voxel_spacing(affine: str) -> list[Column]:
    """Column norms of a 3x3 affine given as an array of nine, row by row."""
    return [F.sqrt(sum(F.get(affine, F.lit(3 * r + c)) * F.get(affine, F.lit(3 * r + c)) for r in range(3))) for c in range(3)]


def argmax_index(c) -> Column:
    """0-based place of the largest element, the first on ties."""
    return F.array_position(c, F.array_max(c)) - 1


def plane_of(spacing: Column) -> Column:
    """Plane of a volume by its axis of largest spacing: sagittal, coronal or axial; null without spacings."""
    at = argmax_index(spacing)
    return F.when(at == 0, "sagittal").when(at == 1, "coronal").when(at == 2, "axial")


def finest_spacing(images: DataFrame, by: list[str], spacing: str, axes: int = 3) -> DataFrame:
    """(by, spacing): the least of each axis over the images of a group, axes one by one; absent axes are null."""
    return images.groupBy(*by).agg(*[F.min(F.get(spacing, F.lit(k))).alias(f"_{k}") for k in range(axes)]).select(*by, F.array(*[f"_{k}" for k in range(axes)]).alias("spacing"))


def orientation_code(acquisition: str, orientation: str) -> Column:
    """0 for a 3D and 5 for a 4D acquisition; else by the axes of the largest row and column cosines 1 axial, 2 coronal,
    3 sagittal, 4 any other pair; null without six cosines."""
    row, column = (argmax_index(F.transform(F.slice(orientation, k, 3), F.abs)) for k in (1, 4))
    code = F.when((row == 0) & (column == 1), 1).when((row == 0) & (column == 2), 2).when((row == 1) & (column == 2), 3).otherwise(4)
    return F.when(F.col(acquisition) == "3D", 0).when(F.col(acquisition) == "4D", 5).when(F.size(orientation) == 6, code)


def middle_slice_pick(headers: DataFrame, series: str, position: tuple[str, str, str], file: str, b_value: str, acquired: str, content: str, image_type: str) -> DataFrame:
    """(series, file, positions, volumes): one file of each series at its middle position.

    Distinct positions are ordered along the axis of largest range; of n the one with n // 2 before it is the middle. Of
    the files there the middle one is taken, by b-value if there are several of them, else by acquisition time, else by
    content time if all have one; else the first whose image type holds the earliest of IMAGE_TYPES, or else the middle
    one by name. Blanks and ties go by file name.
    """
    p = list(position)
    spans = headers.groupBy(series).agg(*[(F.max(c) - F.min(c)).alias(f"_s{k}") for k, c in enumerate(p)])
    axis = argmax_index(F.array(*[f"_s{k}" for k in range(3)]))
    places = headers.select(series, *p).distinct().join(spans.select(series, axis.alias("_axis")), series)
    along = F.element_at(F.array(*p), (F.col("_axis") + 1).cast("int"))
    places = places.withColumns({"_k": F.row_number().over(Window.partitionBy(series).orderBy(along, *p)), "positions": F.count("*").over(Window.partitionBy(series))})
    middle = places.where(F.col("_k") == F.floor(F.col("positions") / 2) + 1).select(series, *p, "positions")
    kind = F.coalesce(*[F.when(F.upper(F.col(image_type)).contains(t), F.lit(k)) for k, t in enumerate(IMAGE_TYPES)])
    files = headers.join(middle, [series, *p]).withColumn("_kind", kind)
    every = Window.partitionBy(series)
    ranks = {f"_{c}": F.row_number().over(every.orderBy(F.col(c).asc_nulls_last(), file)) for c in (b_value, acquired, content, "_kind", file)}
    counts = {"volumes": F.count("*").over(every), "_nb": F.size(F.collect_set(b_value).over(every)), "_na": F.count(acquired).over(every), "_nc": F.count(content).over(every), "_nk": F.count("_kind").over(every)}
    files = files.withColumns({**ranks, **counts})
    half, n = F.floor(F.col("volumes") / 2) + 1, F.col("volumes")
    by_time = F.when(F.col("_na") == n, F.col(f"_{acquired}") == half).when(F.col("_nc") == n, F.col(f"_{content}") == half)
    picked = F.when(F.col("_nb") > 1, F.col(f"_{b_value}") == half).otherwise(F.coalesce(by_time, F.when(F.col("_nk") > 0, F.col("__kind") == 1).otherwise(F.col(f"_{file}") == half)))
    return files.where(picked).select(series, file, "positions", "volumes")


def binarize_mask(voxels: DataFrame, by: list[str], axes: list[str], label: str) -> DataFrame:
    """(by, axes, label 1) of the foreground: labels over 0; cases without any have no rows."""
    return voxels.where(F.col(label) > 0).select(*by, *axes).distinct().withColumn(label, F.lit(1))


def foreground_counts(voxels: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, foreground, dropped) of every case: rows of foreground, and whether :func:`binarize_mask` drops the case."""
    return voxels.groupBy(*by).agg(F.count_if(F.col(label) > 0).alias("foreground")).withColumn("dropped", F.col("foreground") == 0)


def box_fill_mask(boxes: DataFrame, by: list[str], axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """(by, axes): every voxel inside each inclusive box."""
    out = boxes
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(f"{a}0", f"{a}1")))
    return out.select(*by, *axes)


def center_crop_pad(voxels: DataFrame, shapes: DataFrame, by: list[str], axes: list[str], target: list[int]) -> DataFrame:
    """Voxels moved so that a volume of each case's shape (array ``shape``) is cropped around its centre, or padded
    alike on both sides, to the target shape; odd rests go to the far side. Voxels that are cut off are left out."""
    out = voxels.join(shapes.select(*by, "shape"), by)
    moved = {}
    for k, (a, size) in enumerate(zip(axes, target, strict=True)):
        gap = F.lit(size) - F.get("shape", F.lit(k))
        half = F.floor(F.abs(gap) / 2).cast("int")
        moved[a] = F.col(a) + F.when(gap >= 0, half).otherwise(-half)
    out = out.withColumns(moved).drop("shape")
    for a, size in zip(axes, target, strict=True):
        out = out.where(F.col(a).between(0, size - 1))
    return out


def invert_affine(affine: str) -> list[Column]:
    """The 12 numbers of the inverse of an affine given as an array of 12 or 16, row by row; null if it is singular."""
    m = [[F.get(affine, F.lit(4 * r + c)) for c in range(4)] for r in range(3)]
    minor = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    det = F.nullif(sum(m[0][c] * minor(0, c) for c in range(3)), F.lit(0.0))
    inverse = [[minor(c, r) / det for c in range(3)] for r in range(3)]
    return [x for r in range(3) for x in (*inverse[r], -sum(inverse[r][c] * m[c][3] for c in range(3)))]


def reindex_voxels(images: DataFrame, masks: DataFrame, voxels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """(by, x, y, z, label) on each image's whole grid: the label of the mask voxel that lies nearest, through both
    affines; 0 outside the mask, and where it has no voxel.

    ``images`` and ``masks`` have (by, shape, affine), ``voxels`` the mask's labelled voxels (by, x, y, z, label)."""
    case = images.select(*by, F.col("shape").alias("_n"), F.col("affine").cast("array<double>").alias("_i")).join(masks.select(*by, F.col("shape").alias("_m"), F.array(*invert_affine("affine")).alias("_v")), by)
    grid = case
    for k, a in enumerate("xyz"):
        grid = grid.withColumn(a, F.explode(F.sequence(F.lit(0), F.get("_n", F.lit(k)) - 1)))
    to = lambda m, v: [sum(F.get(m, F.lit(4 * r + c)) * v[c] for c in range(3)) + F.get(m, F.lit(4 * r + 3)) for r in range(3)]
    world = grid.withColumns(dict(zip(("_wx", "_wy", "_wz"), to("_i", [F.col(a) for a in "xyz"]), strict=True)))
    at = world.withColumns({f"_{a}": F.bround(c).cast("int") for a, c in zip("xyz", to("_v", [F.col(f"_w{a}") for a in "xyz"]), strict=True)})
    inside = [(F.col(f"_{a}") >= 0) & (F.col(f"_{a}") < F.get("_m", F.lit(k))) for k, a in enumerate("xyz")]
    at = at.withColumn("_in", inside[0] & inside[1] & inside[2])
    labels = voxels.select(*by, *[F.col(a).alias(f"_{a}") for a in "xyz"], F.col(label).alias("_label"))
    return at.join(labels, [*by, "_x", "_y", "_z"], "left").select(*by, "x", "y", "z", F.when(F.col("_in"), F.coalesce("_label", F.lit(0))).otherwise(0).alias(label))


def shape_descriptors(profile: DataFrame, by: list[str], position: str, value: str, n: int) -> DataFrame:
    """(by, dom_k, kurtosis, ptp, mean_sq) of a closed curve's ``n`` radii: the harmonic of largest amplitude (the first
    on ties; 0 for a circle), kurtosis and range of the radii, and mean square."""
    own = harmonic_amplitudes(profile, by, position, value, n, list(range(1, n // 2 + 1)))
    dominant = own.groupBy(*by).agg(F.min(F.struct((-F.round("amplitude", 12)).alias("a"), "k")).alias("_d"))
    dominant = dominant.select(*by, F.when(F.col("_d.a") < 0, F.col("_d.k")).otherwise(0).alias("dom_k"))
    mean = profile.groupBy(*by).agg(F.avg(value).alias("_m"))
    d = F.col(value) - F.col("_m")
    g = profile.join(mean, by).groupBy(*by).agg(F.avg(d * d).alias("_m2"), F.avg(d * d * d * d).alias("_m4"), (F.max(value) - F.min(value)).alias("ptp"), F.avg(F.col(value) * F.col(value)).alias("mean_sq"))
    return dominant.join(g, by).select(*by, "dom_k", F.try_divide("_m4", F.nullif(F.col("_m2") * F.col("_m2"), F.lit(0.0))).alias("kurtosis"), "ptp", "mean_sq")
