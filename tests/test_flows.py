"""Flows whose steps depend on earlier choices, against plain loops over all rows."""

import numpy as np
import pytest
from geomill.kernels import hulls
from geomill.operators import detections as det
from geomill.plans import flows

D = "/root/testdata/sf0.001"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    size = [(x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)]
    return both, *size


def test_sliced_detection(spark):
    rows = flows.slices_of_scores(spark, D).collect()
    boxes = []
    for r in rows:
        cls = int(np.argmax(r.logits))
        s = 800 / 640.0
        cut = lambda x, shift, most: max(0.0, min(most, max(0.0, min(800.0, x * s)) + shift))
        b = (cut(r.cx - r.w / 2, r.slice_x, 1600), cut(r.cy - r.h / 2, r.slice_y, 1200), cut(r.cx + r.w / 2, r.slice_x, 1600), cut(r.cy + r.h / 2, r.slice_y, 1200))
        if r.logits[cls] >= 0.05 and b[0] < b[2] and b[1] < b[3]:
            boxes.append((r.image, cls, -r.logits[cls], r.id, b))
    kept = []
    for x in sorted(boxes):
        if not any(k[:2] == x[:2] and overlap(k[4], x[4])[0] / max(min(overlap(k[4], x[4])[1:]), 1e-10) >= 0.5 for k in kept):
            kept.append(x)
    got = {(r.image, r.id, r.class_id) for r in flows.sliced_detection(spark, D).collect()}
    assert got == {(x[0], x[3], x[1]) for x in kept} and 0 < len(kept) < len(boxes)


def test_at_most_so_many_detections_an_image(spark):
    rows = flows.slices_of_scores(spark, D)
    got = det.sliced(rows, 640.0, 0.05, most=3).groupBy("image").count().collect()
    assert max(r["count"] for r in got) == 3


def test_extent_dedup(spark):
    b, t = flows.dedup_tables(spark, D)
    tiles = t.collect()
    rows = sorted(b.collect(), key=lambda r: r.id)
    of = {}
    for r in rows:
        hit = {k.tile for k in tiles if r.minx <= k.maxx and r.maxx >= k.minx and r.miny <= k.maxy and r.maxy >= k.miny}
        if hit:
            of[r.id] = hit
    rows = [r for r in rows if r.id in of]
    box = [(r.minx, r.miny, r.maxx, r.maxy) for r in rows]
    gone = set()
    for i, r in enumerate(rows):
        if i in gone:
            continue
        for j in range(i + 1, len(rows)):
            if j in gone or not of[r.id] & of[rows[j].id]:
                continue
            both, a, c = overlap(box[i], box[j])
            if both > 0.1 * (a + c - both):
                if r.confidence >= rows[j].confidence:
                    gone.add(j)
                else:
                    gone.add(i)
                    break
    got = {r.id for r in flows.extent_dedup(spark, D).collect()}
    assert got == {r.id for i, r in enumerate(rows) if i not in gone} and gone and len(of) < b.count()


def test_cluster_run(spark):
    rows = flows.cluster_input(spark, D).collect()
    want, tags = {}, {}
    for config in flows.CONFIGS:
        cfg = det.CLUSTERING | config
        p = [r for r in rows if r.class_name in cfg["target_classes"] and (r.confidence is None or r.confidence >= cfg["min_confidence"])]
        at = np.array([(r.x, r.y) for r in p])
        near = ((at[:, None] - at[None]) ** 2).sum(-1) <= cfg["eps_m"] ** 2
        core = near.sum(1) >= cfg["min_samples"]
        part = {i: p[i].id for i in np.flatnonzero(core)}
        for _ in range(len(part)):
            new = {i: min(part[j] for j in np.flatnonzero(near[i] & core)) for i in part}
            if new == part:
                break
            part = new
        label = dict(part)
        for i in np.flatnonzero(~core):
            if (near[i] & core).any():
                label[i] = min(part[j] for j in np.flatnonzero(near[i] & core))
        dense = {k: n for n, k in enumerate(sorted(set(part.values())))}
        label = {i: dense[k] for i, k in label.items()}
        name = cfg["output_class_name"] or "cluster_" + "_".join(cfg["target_classes"])
        for i, k in label.items():
            tags[p[i].id] = f"{name}_{k}"
        for k in set(label.values()):
            own = [i for i, x in label.items() if x == k]
            ring = hulls.convex(at[own]) if cfg["output_geometry"] == "convex_hull" else hulls.smallest_rectangle(at[own])
            area = hulls.area(hulls.grown(ring, cfg["buffer_m"]))
            if len(own) >= cfg["min_cluster_size"] and area >= cfg["min_area_m2"]:
                conf = [p[i].confidence for i in own if p[i].confidence]
                want[f"{name}_{k}"] = (len(own), round(float(np.mean(conf)) if conf else 0.0, 6), round(area, 1))
    shapes, tagged = det.run_clusters(flows.cluster_input(spark, D), flows.CONFIGS)
    assert {r.id: r.cluster_id for r in tagged.collect() if r.cluster_id} == tags
    got = {r.cluster_id: (r.nb_detect, round(r.confidence, 6), r.area_m2) for r in shapes.collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=0.11) for k in want) and want


def test_grown_ring():
    square = np.array([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)])
    assert hulls.grown(square, 1.0).tolist() == [[-1, -1], [3, -1], [3, 2], [-1, 2]]
    assert hulls.area(hulls.grown(hulls.convex([(0, 0), (4, 0), (0, 3)]), 1.0)) == pytest.approx(24.0)


def test_selected(spark):
    rows = spark.createDataFrame([(1,), (2,)], "class_id int")
    assert det.selected(rows, "class_id", None).count() == det.selected(rows, "class_id", []).count() == 2
    assert det.selected(rows, "class_id", [2]).count() == 1


def test_small_clusters_take_their_boxes(spark):
    """Two members have the hull of their boxes, three that of their centres, whatever the geometry asked for."""
    rows = [(1, "a", 0.9, 1.0, 1.0, 0.0, 0.0, 2.0, 2.0), (2, "a", 0.8, 4.0, 1.0, 3.0, 0.0, 5.0, 2.0), *((10 + i, "a", 0.5, 100.0 + 3 * i, 50.0 + 4 * (i % 2), 0.0, 0.0, 1.0, 1.0) for i in range(3))]
    df = spark.createDataFrame(rows, "id int, class_name string, confidence double, x double, y double, minx double, miny double, maxx double, maxy double")
    config = {"target_classes": ["a"], "eps_m": 6.0, "min_samples": 2, "min_cluster_size": 2, "buffer_m": 0.0, "output_geometry": "bounding_box"}
    shapes, tagged = det.run_clusters(df, [config])
    assert {r.cluster_id: (r.nb_detect, r.area_m2) for r in shapes.collect()} == {"cluster_a_0": (2, 10.0), "cluster_a_1": (3, 24.0)}
    assert {r.id: r.cluster_id for r in tagged.collect()} == {1: "cluster_a_0", 2: "cluster_a_0", 10: "cluster_a_1", 11: "cluster_a_1", 12: "cluster_a_1"}


def test_numbered(spark):
    from geomill.operators.numbering import numbered

    rows = [(i % 7 % 3 or None, (i * 37) % 50, i) for i in range(400)] + [(1, 5, 1)] * 100
    df = spark.createDataFrame(rows, "k int, o int, i int").repartition(5)
    got = numbered(df, ["k"], ["o", "i"]).collect()
    for k in (None, 1, 2):
        own = sorted((r.number, r.o, r.i) for r in got if r.k == k)
        assert [n for n, _, _ in own] == list(range(len(own))) and [r[1:] for r in own] == sorted(r[1:] for r in own)
        assert {r.total for r in got if r.k == k} == {len(own)}
    assert numbered(df.limit(0), [], ["o"]).count() == 0
