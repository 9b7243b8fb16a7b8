"""Numeric expressions over array<double> columns: one implementation for building and for querying."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0.0


def let(value: Column, body) -> Column:
    """body(value), value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quotient(a: Column, b: Column) -> Column:
    """a / b as doubles have it: by zero infinite, or NaN for zero by zero; null only where a or b is."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    """The natural logarithm as doubles have it: -infinity of zero, NaN below; null only of null."""
    return F.when(x == 0, float("-inf")).when(x < 0, float("nan")).otherwise(F.ln(x))


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(ZERO), lambda a, x: a + x)


def mean(xs: Column) -> Column:
    return F.try_divide(total(xs), F.size(xs))


def median(xs: Column) -> Column:
    """Middle value, or the mean of both middle values."""
    s = lambda v: (F.get(v, F.expr("0") + F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    return let(F.array_sort(xs), s)


def std_pop(xs: Column) -> Column:
    return let(mean(xs), lambda m: F.sqrt(total(F.transform(xs, lambda x: (x - m) * (x - m))) / F.size(xs)))


def zscore_clip(xs: Column, clip: float = 3.0) -> Column:
    """Population z-score, a deviation under 1e-9 counting as 1, clipped."""

    def scale(m: Column) -> Column:
        sd = F.sqrt(total(F.transform(xs, lambda x: (x - m) * (x - m))) / F.size(xs))
        return let(F.when(sd < 1e-9, 1.0).otherwise(sd), lambda d: F.transform(xs, lambda x: F.least(F.lit(clip), F.greatest(F.lit(-clip), (x - m) / d))))

    return let(mean(xs), scale)


def resample(xs: Column, n: int, d: int) -> Column:
    """Linear interpolation of n values at d even places, both ends included."""
    places = []
    for i in range(d):
        pos = i * (n - 1) / (d - 1)
        lo = math.floor(pos)
        places.append((lo, min(lo + 1, n - 1), pos - lo))
    return F.array(*[(1 - w) * F.get(xs, F.lit(lo)) + w * F.get(xs, F.lit(hi)) for lo, hi, w in places])


def detrend(xs: Column, n: int) -> Column:
    """Residuals of the least-squares line over the index."""
    mid = (n - 1) / 2
    sxx = sum((i - mid) ** 2 for i in range(n))
    slope = F.aggregate(F.transform(xs, lambda x, i: x * (i - mid)), F.lit(ZERO), lambda a, x: a + x) / sxx
    return let(slope, lambda b: let(mean(xs), lambda m: F.transform(xs, lambda x, i: x - m - b * (i - mid))))


def squared_l2(a: Column, b: Column, dim: int, first: int = 0) -> Column:
    """Sum of squared differences over dim places from ``first``, unrolled so that it stays in generated code."""
    out = None
    for i in range(first, first + dim):
        diff = F.get(a, F.lit(i)) - F.get(b, F.lit(i))
        out = diff * diff if out is None else out + diff * diff
    return out


def shape_vector(close: Column, qv: Column, win: int, dst: int = 32) -> Column:
    """Detrended log closes and log volumes, each z-scored, clipped and resampled to dst places.

    A close of zero leaves no finite mean: all places of the closes are then the upper end of the clip.
    """
    shape = let(zscore_clip_of(detrend_of(F.transform(close, log), win)), lambda x: resample(x, win, dst))
    return F.concat(shape, volume_part(qv, win, dst))


def raw_vector(close: Column, qv: Column, win: int, dst: int = 32) -> Column:
    """As shape_vector without the detrending."""
    raw = let(zscore_clip_of(F.transform(close, log)), lambda x: resample(x, win, dst))
    return F.concat(raw, volume_part(qv, win, dst))


def volume_part(qv: Column, win: int, dst: int) -> Column:
    return let(zscore_clip_of(F.transform(qv, F.log1p)), lambda x: resample(x, win, dst))


def zscore_clip_of(xs: Column) -> Column:
    return let(xs, lambda x: zscore_clip(x))  # one parameter: a second would be the place


def detrend_of(xs: Column, n: int) -> Column:
    return let(xs, lambda x: detrend(x, n))


def block_vectors(open_: Column, high: Column, low: Column, close: Column, volume: Column, win: int) -> Column:
    """Struct of the ATR-normalised blocks resid(48), raw(48), vol(8), range(4), trend(4) and atr.

    The true range of the first bar is its own range; blocks are null where the mean true range is not positive.
    """
    mid = (win - 1) / 2
    sxx = sum((i - mid) ** 2 for i in range(win))

    def true_ranges(c: Column) -> Column:
        def one(h: Column, i: Column) -> Column:
            lo, pc = F.get(low, i), F.get(c, i - 1)
            return F.when(i == 0, h - lo).otherwise(F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)))

        return F.transform(high, one)

    def build(c: Column, tr: Column, a: Column) -> Column:
        c0, last = F.get(c, F.lit(0)), F.get(c, F.lit(win - 1))

        def trend(res: Column) -> Column:
            ss_res = total(F.transform(res, lambda x: x * x))
            ss_tot = let(mean(c), lambda m: total(F.transform(c, lambda x: (x - m) * (x - m))))
            r2 = 1 - (ss_res / win) / F.greatest(ss_tot / win, F.lit(1e-18))
            top, bottom = F.array_max(high), F.array_min(low)
            pos = (last - bottom) / F.greatest(top - bottom, F.lit(1e-18))
            return F.array((last - c0) / a, r2, pos, (top - bottom) / a)

        def vol(v: Column) -> Column:
            logs = let(F.greatest(median(v), F.lit(1e-12)), lambda m: F.transform(v, lambda x: F.ln(F.greatest((x + m * 1e-9) / m, F.lit(1e-9)))))
            return let(logs, lambda x: resample(x, win, 8))

        return let(
            detrend(c, win),
            lambda res: F.struct(
                let(F.transform(res, lambda x: x / a), lambda x: resample(x, win, 48)).alias("resid"),
                let(F.transform(c, lambda x: (x - c0) / a), lambda x: resample(x, win, 48)).alias("raw"),
                vol(volume).alias("vol"),
                let(F.transform(tr, lambda x: x / a), lambda x: resample(x, win, 4)).alias("range"),
                trend(res).alias("trend"),
                a.alias("atr"),
            ),
        )

    assert sxx > 0
    blocks = let(true_ranges(close), lambda tr: let(mean(tr), lambda a: F.when(a > 0, build(close, tr, a))))
    return blocks


def full_vector(blocks: Column, scales: dict[str, Column]) -> Column:
    """The 64 places resid, vol, range and trend of block_vectors, each block over its scale: one for library and query."""
    return F.concat(*[F.transform(blocks[b], _over(scales[b])) for b in ("resid", "vol", "range", "trend")])


def _over(scale: Column):
    return lambda x: x / scale


def true_ranges(high: Column, low: Column, close: Column) -> Column:
    """True range of each bar of a window, that of the first being its own range."""

    def one(h: Column, i: Column) -> Column:
        lo, pc = F.get(low, i), F.get(close, i - 1)
        return F.when(i == 0, h - lo).otherwise(F.greatest(h - lo, F.abs(h - pc), F.abs(lo - pc)))

    return F.transform(high, one)


def overlay(close: Column, win: int, clip: float = 3.0) -> Column:
    """The curve to draw one window over another: log closes, detrended, over their deviation, clipped."""
    return let(F.transform(close, F.ln), lambda x: zscore_clip_of(detrend_of(x, win)))
