"""Candles from pictures of charts."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "origin string, open_time long, open double, high double, low double, close double, volume double"


def candles(rgb: np.ndarray, t0: int, step_ms: int, top: float, bottom: float, log: bool = False, body: float = 0.55, box: tuple[int, int, int, int] | None = None, least: int = 0) -> pd.DataFrame:
    """One candle for each run of coloured columns; green rises, red falls.

    Rows coloured over ``body`` of a run's width are its body, the others its wick; without such rows the
    widest row is both open and close. top and bottom are the prices of the first and the last row. box (left, top,
    right, bottom) is the plot area, by default the whole picture. Fewer than ``least`` candles: an error.
    """
    if box:
        rgb = rgb[box[1] : box[3], box[0] : box[2]]
    r, g, b = (rgb[..., i].astype(int) for i in range(3))
    up, down = (g > r + 30) & (g > b), (r > g + 30) & (r > b)
    ink = up | down
    on = ink.any(axis=0)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
    height = max(rgb.shape[0] - 1, 1)

    def price(row: float) -> float:
        share = row / height
        return math.exp(math.log(top) + share * (math.log(bottom) - math.log(top))) if log else top + share * (bottom - top)

    out = []
    for k, (a, z) in enumerate(zip(edges[::2], edges[1::2], strict=True)):
        part = ink[:, a:z]
        rows, wide = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.sum(axis=1) >= body * (z - a))
        if not len(wide):
            wide = np.array([int(part.sum(axis=1).argmax())])
        rising = up[:, a:z].sum() >= down[:, a:z].sum()
        high_side, low_side = price(wide[0]), price(wide[-1])
        out.append((t0 + k * step_ms, low_side if rising else high_side, price(rows[0]), price(rows[-1]), high_side if rising else low_side, 1.0))
    if len(out) < least:
        raise ValueError(f"only {len(out)} candles, {least} are needed")
    return pd.DataFrame(out, columns=["open_time", "open", "high", "low", "close", "volume"])


def read_charts(spark: SparkSession, path: str, t0: int, step_ms: int, top: float, bottom: float, log: bool = False) -> DataFrame:
    """Candles of every picture under path, a picture a task row; Spark's image source gives blue first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x in pdf.itertuples(index=False):
                img = np.frombuffer(x.data, np.uint8).reshape(x.height, x.width, x.nChannels)[..., 2::-1]
                yield candles(img, t0, step_ms, top, bottom, log).assign(origin=x.origin)

    images = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*").where("nChannels >= 3")
    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, SCHEMA)
