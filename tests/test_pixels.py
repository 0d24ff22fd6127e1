"""Images of a batch are resized together where their sizes are equal, each as it would be alone."""

import random

import numpy as np
import pytest

from pagewright.functions import pixels


@pytest.mark.parametrize("kernel", ["lanczos", "bilinear"])
def test_images_of_many_sizes(kernel, spark, monkeypatch):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        w, h, c, tw, th = rng.choice([(6, 1, 1, 4, 1), (4, 4, 1, 2, 2), (3, 5, 3, 7, 2), (1, 1, 4, 3, 3)])
        rows.append((i, [rng.randrange(256) for _ in range(w * h * c)], w, h, c, tw, th))
    rows += [(200, None, 1, 1, 1, 1, 1), (201, [], 0, 0, 1, 1, 1), (202, [1], 1, 1, 1, 0, 1), (203, [1, 2], 1, 1, 1, 1, 1), (204, [1], None, 1, 1, 1, 1), (205, [1], 1, 1, 1, 1, None)]
    images = spark.createDataFrame(rows, "id long, pixels array<int>, pixel_width int, pixel_height int, channels int, w int, h int").coalesce(1)
    got = {r["id"]: r["pixels"] for r in pixels.resized(images, "w", "h", kernel).collect()}
    for i, flat, w, h, c, tw, th in rows:
        if i >= 200:
            assert got[i] is None
            continue
        own = np.array(flat, float).reshape(h, w, c)
        u, v = np.meshgrid((np.arange(tw) + 0.5) / tw, (np.arange(th) + 0.5) / th)
        want = pixels.lanczos(own, tw, th) if kernel == "lanczos" else pixels.bilinear(own, u, v)
        assert got[i] == want.ravel().tolist()


def test_equal_sizes_are_one_call(monkeypatch):
    import pyarrow as pa

    calls, kernel = [], pixels.lanczos
    monkeypatch.setattr(pixels, "lanczos", lambda *args: calls.append(1) or kernel(*args))
    n = 500
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([[i % 256] * 6 for i in range(n)], pa.list_(pa.int32())), *(pa.array([x] * n) for x in (6, 1, 1, 4, 1))], list("abcdefg"))
    assert pixels._alike(batch, "lanczos").to_pylist() == [[i % 256] * 4 for i in range(n)]
    assert len(calls) == 1
