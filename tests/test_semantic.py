"""Class maps of sliced images against plain arrays that are stretched and added up."""

import numpy as np
import pytest

from geomill.operators import semantic


def stretched(p, height, width):
    """(classes, rows, cols) to (classes, height, width), bilinear with half-pixel centres and clamped borders."""
    out = np.zeros((p.shape[0], height, width))
    for y in range(height):
        for x in range(width):
            v, u = (y + 0.5) * p.shape[1] / height - 0.5, (x + 0.5) * p.shape[2] / width - 0.5
            v, u = min(max(v, 0), p.shape[1] - 1), min(max(u, 0), p.shape[2] - 1)
            a, b = int(v), int(u)
            c, d = min(a + 1, p.shape[1] - 1), min(b + 1, p.shape[2] - 1)
            out[:, y, x] = (p[:, a, b] * (1 - u + b) + p[:, a, d] * (u - b)) * (1 - v + a) + (p[:, c, b] * (1 - u + b) + p[:, c, d] * (u - b)) * (v - a)
    return out


def plain(slices, scores, img_h, img_w, threshold, bias):
    total, votes = np.zeros((3, img_h, img_w)), np.zeros((img_h, img_w))
    for (_, k, rows, cols, x0, y0, w, h, _, _), s in zip(slices, scores, strict=True):
        e = np.exp(s - s.max(0))
        p = stretched(e / e.sum(0), h, w)
        h, w = min(h, img_h - y0), min(w, img_w - x0)
        total[:, y0 : y0 + h, x0 : x0 + w] += np.rint(p[:, :h, :w] * semantic.UNITS)
        votes[y0 : y0 + h, x0 : x0 + w] += 1
    mean = total / np.maximum(votes, 1) / semantic.UNITS
    if bias:
        mean[0] = np.clip(mean[0] - bias, 0, 1)
    cls, conf = mean.argmax(0), mean.max(0)
    cls[conf < threshold] = 0
    return {(x, y): (int(cls[y, x]), conf[y, x], int(votes[y, x])) for y in range(img_h) for x in range(img_w) if votes[y, x]}


@pytest.mark.parametrize(("bias", "threshold"), [(0.0, 0.45), (0.2, 0.3)])
@pytest.mark.parametrize(("rows", "cols", "w", "h"), [(4, 4, 9, 8), (5, 3, 5, 3), (7, 8, 4, 5), (1, 2, 6, 6)])
def test_plain_arrays(spark, rows, cols, w, h, bias, threshold):
    rng = np.random.default_rng(rows * cols)
    img_h, img_w = 13, 15
    slices, scores, cells = [], [], []
    for k, (x0, y0) in enumerate([(0, 0), (w - 2, 0), (0, h - 2), (w - 2, h - 2)]):
        slices.append(("im", k, rows, cols, x0, y0, w, h, img_w, img_h))
        scores.append(rng.normal(0, 2, (3, rows, cols)))
        cells += [("im", k, r, c, scores[-1][:, r, c].tolist()) for r in range(rows) for c in range(cols)]
    sl = spark.createDataFrame(slices, "image string, slice int, rows int, cols int, start_x int, start_y int, width int, height int, img_width int, img_height int")
    ce = spark.createDataFrame(cells, "image string, slice int, r int, c int, logits array<double>").repartition(3)
    got = {(r.x, r.y): (r.cls, r.conf, r.votes) for r in semantic.class_map(semantic.resampled(ce, sl), 3, threshold, bias).collect()}
    want = plain(slices, scores, img_h, img_w, threshold, bias)
    assert set(got) == set(want)
    for k, (cls, conf, votes) in want.items():
        assert got[k][1] == pytest.approx(conf, abs=3e-9) and got[k][2] == votes
        assert got[k][0] == cls or abs(conf - threshold) < 1e-8


def test_a_missing_cell(spark):
    """Pixels that need the cell are left out, others are not."""
    sl = spark.createDataFrame([("im", 0, 2, 3, 0, 0, 3, 2, 3, 2)], "image string, slice int, rows int, cols int, start_x int, start_y int, width int, height int, img_width int, img_height int")
    cells = [("im", 0, r, c, [0.0, float(c)]) for r in range(2) for c in range(3) if (r, c) != (1, 2)]
    ce = spark.createDataFrame(cells, "image string, slice int, r int, c int, logits array<double>")
    got = {(r.x, r.y) for r in semantic.resampled(ce, sl).collect()}
    assert (0, 0) in got and (0, 1) in got and (2, 1) not in got
    assert semantic.class_map(semantic.resampled(ce.limit(0), sl), 2, 0.5).count() == 0
