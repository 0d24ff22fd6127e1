"""Resampling kernels over arrays of interleaved channels, as functions of Arrow batches.

An image is one row: its pixels (array of 0 to 255), width, height and channels. Spark spreads the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Fixed value: lobes of the windowed sine.
LOBES = 3
#: Fixed value: channels of pixels that are resized at once.
CELLS = 1 << 21


def _taps(source: int, target: int) -> np.ndarray:
    """A row of weights over the source for each target place: a windowed sine, as wide as the ratio when shrinking."""
    ratio = source / target
    wide = max(1.0, ratio)
    centre = (np.arange(target) + 0.5) * ratio
    x = (np.arange(source)[None] + 0.5 - centre[:, None]) / wide
    weights = np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)
    return weights / weights.sum(1, keepdims=True)


def lanczos(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """An image (height, width, channels) at another size, first its rows, then its columns, rounded at the end."""
    tall = np.tensordot(_taps(pixels.shape[0], height), pixels.astype(float), (1, 0))
    out = np.tensordot(tall, _taps(pixels.shape[1], width), (1, 1)).transpose(0, 2, 1)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def bilinear(pixels: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Samples at shares (u across, v down) of an image, between the four nearest pixel centres, rounded half up."""
    h, w = pixels.shape[:2]
    x, y = np.clip(u * w - 0.5, 0, w - 1), np.clip(v * h - 0.5, 0, h - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    tx, ty = (x - x0)[..., None], (y - y0)[..., None]
    top, low = (pixels[r, x0] * (1 - tx) + pixels[r, x1] * tx for r in (y0, y1))
    return np.floor(top * (1 - ty) + low * ty + 0.5).astype(np.uint8)


def _alike(batch: pa.RecordBatch, kernel: str) -> pa.Array:
    """The images of a batch (pixels, width, height, channels and new size after the id) at their new sizes: those of equal sizes at once."""
    pixels = batch.column(1)
    sizes = pd.DataFrame({i: batch.column(i).to_pandas() for i in range(2, 7)})
    lengths = pc.list_value_length(pixels).to_pandas()
    fine = sizes.notna().all(axis=1) & lengths.notna() & (lengths > 0) & (sizes[2] * sizes[3] * sizes[4] == lengths) & (sizes[5] >= 1) & (sizes[6] >= 1)
    made: list[np.ndarray | None] = [None] * batch.num_rows
    for (w, h, c, tw, th), rows in sizes[fine].astype("int64").groupby(list(sizes.columns)):
        step = max(1, CELLS // max(w * h * c, tw * th * c, w * th * c))
        for k in range(0, len(rows), step):
            own = rows.index[k : k + step].to_numpy()
            flat = pc.list_flatten(pixels.take(pa.array(own))).to_numpy(zero_copy_only=False).astype(np.float64)
            # images side by side are channels of one
            held = flat.reshape(len(own), h, w, c).transpose(1, 2, 0, 3).reshape(h, w, len(own) * c)
            if kernel == "lanczos":
                out = lanczos(held, tw, th)
            else:
                u, v = np.meshgrid((np.arange(tw) + 0.5) / tw, (np.arange(th) + 0.5) / th)
                out = bilinear(held, u, v)
            for j, image in zip(own.tolist(), out.reshape(th, tw, len(own), c).transpose(2, 0, 1, 3).reshape(len(own), -1), strict=True):
                made[j] = image
    counts = np.array([0 if x is None else len(x) for x in made])
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([*(x is None for x in made), False]))
    values = np.concatenate([x for x in made if x is not None]) if counts.any() else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def resized(images: DataFrame, width: str, height: str, kernel: str = "lanczos") -> DataFrame:
    """Rows of ``images`` (id, pixels, pixel_width, pixel_height, channels) with their pixels at the size in two columns.

    A row whose pixels don't fill its size, or whose size is empty, has null pixels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _alike(batch, kernel)], ["id", "pixels"])

    own = images.selectExpr("id", "pixels", "pixel_width", "pixel_height", "channels", width, height)
    return own.mapInArrow(run, f"id {dict(own.dtypes)['id']}, pixels array<int>")
