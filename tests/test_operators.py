"""Sequential versions written from the definitions, invariants and edge cases."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelmill.functions import activations as act
from labelmill.functions import codes
from labelmill.functions import geometry as G
from labelmill.operators import annotations as ann
from labelmill.operators import boxes, coco, decode, matching, metrics, ordering, rasters, sampling

PX = "image_id long, y long, x long, gt long, pred long"


def pixels(rng, images=3, side=8, labels=4):
    rows = []
    for i in range(images):
        for y, x in itertools.product(range(side), range(side)):
            gt = 255 if rng.random() < 0.15 else (x // 4 + y // 4) % labels
            rows.append((i, y, x, gt, rng.choice([255, gt if gt != 255 else 0, (x // 3) % labels])))
    return rows


def pq_loop(rows, void=255):
    stats = defaultdict(lambda: [0.0, 0, 0, 0])
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        group = list(group)
        inter, ga, pa = defaultdict(int), defaultdict(int), defaultdict(int)
        for _, _, _, g, p in group:
            inter[g, p] += 1
            ga[g] += 1
            pa[p] += 1
        hit_g, hit_p = set(), set()
        for (g, p), n in inter.items():
            if g == void or g != p:
                continue
            iou = n / (ga[g] + pa[p] - n - inter.get((void, p), 0))
            if iou > 0.5:
                stats[g][0] += iou
                stats[g][1] += 1
                hit_g.add(g)
                hit_p.add(p)
        for g in ga:
            if g != void and g not in hit_g:
                stats[g][3] += 1
        for p in pa:
            if p != void and p not in hit_p and inter.get((void, p), 0) / pa[p] <= 0.5:
                stats[p][2] += 1
    return {k: tuple(v) for k, v in stats.items()}


def test_panoptic_quality_equals_a_loop(spark):
    rows = pixels(random.Random(1))
    got = {r["category_id"]: (r["iou"], r["tp"], r["fp"], r["fn"]) for r in metrics.pq_stats(metrics.overlaps(spark.createDataFrame(rows, PX)), 255).collect()}
    want = pq_loop(rows)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])
    for r in metrics.pq_classes(metrics.pq_stats(metrics.overlaps(spark.createDataFrame(rows, PX)), 255)).collect():
        assert r["pq"] == pytest.approx(r["sq"] * r["rq"])


def test_panoptic_quality_of_void_only_and_of_no_pixels(spark):
    void = spark.createDataFrame([(0, 0, x, 255, 1) for x in range(4)], PX)
    assert metrics.pq_stats(metrics.overlaps(void), 255).count() == 0
    assert metrics.pq_stats(metrics.overlaps(void.limit(0)), 255).count() == 0


def test_run_lengths_round_trip(spark):
    rng = random.Random(2)
    mask = {(y, x) for y in range(5) for x in range(7) if rng.random() < 0.5} | {(0, 0)}
    px = spark.createDataFrame([(1, y, x) for y, x in mask], "image_id long, y long, x long")
    rle = rasters.rle_encode(px, ["image_id"], 5, 7)
    row = rle.first()["rle"]
    assert sum(row["counts"]) == 35 and row["counts"][0] == 0  # starts with foreground
    back = {(r["y"], r["x"]) for r in rasters.rle_decode(rle).collect()}
    assert back == mask
    assert rle.select(rasters.rle_area(F.col("rle")).alias("a")).first()["a"] == len(mask)


def test_runs_meet_like_pixels(spark):
    px = spark.createDataFrame(pixels(random.Random(3)), PX)
    a, b = rasters.pixels_to_runs(px.drop("pred"), "gt"), rasters.pixels_to_runs(px.drop("gt"), "pred")
    runs = {(r["gt"], r["pred"]): r["n"] for r in metrics.confusion(rasters.run_overlap(a, b, "gt", "pred"), 255, 4, weight="n").collect()}
    assert runs == {(r["gt"], r["pred"]): r["n"] for r in metrics.confusion(px, 255, 4).collect()}


def test_boundary_touches_the_edge(spark):
    px = spark.createDataFrame([(1, y, x) for y in range(5) for x in range(5)], "image_id long, y long, x long")
    assert rasters.boundary_band(px, ["image_id"], 1).count() == 16  # all but the inner 3 x 3


def test_polygon_fills_pixel_centres(spark):
    poly = spark.createDataFrame([(1, [1.0, 1.0, 4.0, 1.0, 4.0, 3.0, 1.0, 3.0])], "id long, points array<double>")
    got = {(r["y"], x) for r in rasters.rasterize_polygons(poly, ["id"]).collect() for x in range(r["x0"], r["x1"])}
    assert got == {(y, x) for y in (1, 2) for x in (1, 2, 3)}


def test_empty_mask_box(spark):
    masks = spark.createDataFrame([(1, 1), (1, 2)], "image_id long, label long")
    px = spark.createDataFrame([(1, 1, 3, 4)], "image_id long, label long, y long, x long")
    got = {r["label"]: tuple(r)[2:] for r in rasters.mask_boxes_or_default(masks, px, ["image_id", "label"]).collect()}
    assert got == {1: (4.0, 3.0, 4.0, 3.0), 2: (1e8, 1e8, 0.0, 0.0)}


def test_box_measures(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(50):
        a, b = ([rng.uniform(0, 50), rng.uniform(0, 50)] for _ in range(2))
        rows.append((*a, a[0] + rng.uniform(0, 20), a[1] + rng.uniform(0, 20), *b, b[0] + rng.uniform(0, 20), b[1] + rng.uniform(0, 20)))
    names = [p + n for p in ("a_", "b_") for n in ("x0", "y0", "x1", "y1")]
    df = boxes.matched_iou(spark.createDataFrame(rows, names))
    back = boxes.matched_iou(df.select(*[F.col(("b_" if n[0] == "a" else "a_") + n[2:]).alias(n) for n in names]))
    for r, s in zip(df.collect(), back.collect()):
        assert 0 <= r["iou"] <= 1 and -1 <= r["giou"] <= r["iou"] + 1e-9
        assert r["iou"] == pytest.approx(s["iou"])
    zero = boxes.matched_iou(spark.createDataFrame([(1.0,) * 8], names)).first()
    assert zero["iou"] is None


def test_box_forms_and_codes(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0, 9.0)], "x0 double, y0 double, x1 double, y1 double")
    back = df.select(*[c.alias(n) for c, n in zip(G.cxcywh_to_xyxy(G.xyxy_to_cxcywh(G.columns())), ("x0", "y0", "x1", "y1"))])
    assert back.first() == df.first()
    t = spark.createDataFrame([("/a/b.c/x.tar.png", 0, 66051)], "p string, v long, i long")
    row = t.select(codes.stem_first_dot(F.col("p")).alias("a"), codes.stem_last_dot(F.col("p")).alias("b"), codes.with_extension(F.col("p"), ".jpg").alias("c"), codes.shifted_label(F.col("v")).alias("d"), F.array(*codes.id_to_rgb(F.col("i"))).alias("e")).first()
    assert tuple(row) == ("x", "x.tar", "/a/b.c/x.tar.jpg", 255, [3, 2, 1])


def test_invalid_boxes(spark):
    rows = [(1, 0.0, 0.0, 1.0, 1.0), (2, 2.0, 0.0, 1.0, 1.0), (3, None, 0.0, 1.0, 1.0), (4, 0.0, float("nan"), 1.0, 1.0), (5, 1.0, 1.0, 1.0, 1.0)]
    assert sorted(r["k"] for r in boxes.invalid_boxes(spark.createDataFrame(rows, "k int, x0 double, y0 double, x1 double, y1 double")).collect()) == [2, 3, 4]


def test_grid_finds_each_overlap_once(spark):
    rng = random.Random(5)
    make = lambda n: [(0, i, *(lambda x, y: (x, y, x + rng.uniform(1, 90), y + rng.uniform(1, 90)))(rng.uniform(-50, 200), rng.uniform(-50, 200))) for i in range(n)]
    a, b = (spark.createDataFrame(make(40), "image_id int, k int, x0 double, y0 double, x1 double, y1 double") for _ in range(2))
    grid = sorted((r["a_k"], r["b_k"]) for r in boxes.overlapping_pairs(a, b, ["image_id"], 32.0).collect())
    every = sorted((r["a_k"], r["b_k"]) for r in boxes.pairwise_iou(a, b, ["image_id"]).filter("iou > 0").collect())
    assert grid == every


def greedy_loop(gt, det, t):
    taken, out = set(), {}
    for d in sorted(det, key=lambda d: (-d[6], d[1])):
        best = None
        for g in gt:
            if g[:1] + g[7:] != d[:1] + d[7:]:
                continue
            iw, ih = min(d[4], g[4]) - max(d[2], g[2]), min(d[5], g[5]) - max(d[3], g[3])
            if iw <= 0 or ih <= 0:
                continue
            da, gb = (d[4] - d[2]) * (d[5] - d[3]), (g[4] - g[2]) * (g[5] - g[3])
            v = round(iw * ih / da if g[6] else iw * ih / (da + gb - iw * ih), 12)
            if v < t or (not g[6] and g[1] in taken):
                continue
            key = (g[6], -v, g[1])
            if best is None or key < best:
                best = key
        if best:
            out[d[1]] = (best[2], bool(best[0]))
            if not best[0]:
                taken.add(best[2])
    return out


def test_greedy_matching_equals_a_loop(spark):
    rng = random.Random(6)
    gt = [(0, i, float(x), float(y), x + 30.0, y + 30.0, int(i % 7 == 0), i % 2) for i, (x, y) in enumerate((rng.randrange(0, 200), rng.randrange(0, 200)) for _ in range(40))]
    det = [(0, 100 + i, g[2] + rng.randrange(-8, 8), g[3] + rng.randrange(-8, 8), g[4] + rng.randrange(-8, 8), g[5], rng.randrange(5) / 5, g[7]) for i, g in enumerate(gt * 2)]
    g = spark.createDataFrame(gt, "image_id long, gt_id long, x0 double, y0 double, x1 double, y1 double, iscrowd int, category_id int")
    d = spark.createDataFrame(det, "image_id long, det_id long, x0 double, y0 double, x1 double, y1 double, score double, category_id int")
    got = matching.greedy_match(matching.box_pairs(g, d), d, (0.5, 0.75)).collect()
    assert len(got) == 2 * len(det)
    for t in (0.5, 0.75):
        want = greedy_loop(gt, det, t)
        assert {r["det_id"]: (r["gt_id"], r["ignored"]) for r in got if r["t"] == t and r["gt_id"] is not None} == want


def test_average_precision_equals_a_lookup(spark):
    rng = random.Random(7)
    rows = [(c, i, rng.random(), int(rng.random() < 0.6)) for c in range(3) for i in range(30)]
    truth = [(0, 25), (1, 40), (2, 18), (3, 5)]
    got = {r["c"]: r["ap"] for r in metrics.average_precision(spark.createDataFrame(rows, "c int, det_id long, score double, tp int"), spark.createDataFrame(truth, "c int, n_gt long"), ["c"]).collect()}
    for c, n in truth:
        tp, curve = 0, []
        for k, r in enumerate(sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])), 1):
            tp += r[3]
            curve.append((tp / n, tp / k))
        want = sum(max([p for rec, p in curve if rec >= i / 100 - 1e-12], default=0.0) for i in range(101)) / 101
        assert got[c] == pytest.approx(want, abs=1e-9)


def test_assignment_is_least_cost():
    rng = np.random.default_rng(8)
    for n, m in ((1, 1), (3, 5), (4, 4), (2, 6)):
        c = rng.normal(size=(n, m))
        cols = matching.shortest_augmenting_paths(c)
        assert len(set(cols.tolist())) == n
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(m), n))
        assert c[np.arange(n), cols].sum() == pytest.approx(best)


def test_assignment_of_more_queries_than_truths(spark):
    rows = [(1, q, g, float((q * 7 + g * 3) % 5)) for q in range(4) for g in range(2)]
    got = matching.assign(spark.createDataFrame(rows, "image_id long, q long, gt_id long, cost double")).collect()
    assert len(got) == 2 and len({r["q"] for r in got}) == 2


def panoptic_loop(cls, mask, things, mask_thr, overlap, t=0.06):
    sig = lambda v: 1 / (1 + math.exp(-v))
    kept = []
    for q, logits in sorted(cls.items()):
        s = [sig(v) for v in logits]
        if max(s) > mask_thr:
            e = [math.exp((v - max(s)) / t) for v in s]
            p = [v / sum(e) for v in e]
            kept.append((q, p.index(max(p)), max(p)))
    out, area, leader, n = {}, {}, {}, 0
    won = {}
    for px in next(iter(mask.values())):
        if kept:
            won[px] = max(kept, key=lambda k: (round(k[2] * sig(mask[k[0]][px]), 9), -k[0]))[0]
    for q, c, _ in kept:
        mine = [px for px, w in won.items() if w == q]
        orig = [px for px, v in mask[q].items() if sig(v) >= 0.5]
        final = [px for px in mine if sig(mask[q][px]) >= 0.5]
        if not mine or not orig or not final or len(mine) / len(orig) < overlap:
            continue
        if c not in things and c in leader:
            seg = leader[c]
        else:
            n += 1
            seg = n
            if c not in things:
                leader[c] = seg
        for px in final:
            out[px] = seg
        area[seg] = (c, area.get(seg, (c, 0))[1] + len(final))
    return out, area


def test_panoptic_merge_equals_the_sequential_rule(spark):
    rng = random.Random(9)
    cls = {q: [rng.uniform(-3, 2) for _ in range(4)] for q in range(6)}
    mask = {q: {(y, x): 4 - 1.5 * max(abs(x - rng_x), abs(y - rng_y)) for y in range(8) for x in range(8)} for q, (rng_x, rng_y) in enumerate((rng.randrange(8), rng.randrange(8)) for _ in range(6))}
    df_cls = spark.createDataFrame([(1, q, c, v) for q, vs in cls.items() for c, v in enumerate(vs)], "image_id long, q long, c long, logit double")
    df_mask = spark.createDataFrame([(1, q, y, x, v) for q, m in mask.items() for (y, x), v in m.items()], "image_id long, q long, y long, x long, logit double")
    things = spark.createDataFrame([(c, int(c < 2)) for c in range(4)], "c long, isthing int")
    px, seg = decode.panoptic_merge(df_cls, df_mask, things, 0.25, 0.3)
    want_px, want_seg = panoptic_loop(cls, mask, {0, 1}, 0.25, 0.3)
    assert {(r["y"], r["x"]): r["seg_id"] for r in px.collect() if r["seg_id"]} == want_px
    assert {r["seg_id"]: (r["category_id"], r["area"]) for r in seg.collect()} == want_seg
    none_px, none_seg = decode.panoptic_merge(df_cls, df_mask, things, 1.0, 0.3)
    assert none_seg.count() == 0 and none_px.filter("seg_id <> 0").count() == 0 and none_px.count() == 64


def test_topk_asks_for_more_than_there_is(spark):
    cls = spark.createDataFrame([(1, q, c, 0.0) for q in range(2) for c in range(2)], "image_id long, q long, c long, logit double")
    got = decode.topk_pairs(cls, 100).orderBy("rank").collect()
    assert [(r["q"], r["c"]) for r in got] == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_category_maps(spark):
    cats = spark.createDataFrame([(0, 10, 1), (1, 20, 0), (2, 30, 1)], "pos long, id long, isthing int")
    got = ann.to_contiguous(spark.createDataFrame([(10,), (20,), (30,), (99,)], "category_id long"), cats).orderBy("category_id").collect()
    assert [(r["contiguous_id"], r["isthing"]) for r in got] == [(0, True), (1, False), (1, True), (None, None)]
    lines = spark.createDataFrame([(0, "ins sem full"), (1, "1 5 x"), (2, "1  7\ty"), (3, "2 3 z")], "line_no long, value string")
    assert {r["ins_id"]: r["sem_id"] for r in ann.read_id_map_lines(lines).collect()} == {1: 6, 2: 2}


def test_filters_default_missing_fields(spark):
    rows = [(1, None, None), (2, 1, None), (3, 0, 0.2)]
    df = spark.createDataFrame(rows, "image_id int, iscrowd int, visibility_fraction double")
    assert sorted(r["image_id"] for r in ann.keep_objects(df, 0.5).collect()) == [1]
    assert sorted(r["image_id"] for r in ann.drop_empty_images(df.select("image_id"), df).collect()) == [1, 3]


def test_stride_rounds_half_to_even(spark):
    df = spark.range(20).select(F.col("id").alias("k"), F.lit(0).alias("g"))
    assert [r["k"] for r in sampling.stride_sample(df, 0.4, "k", "g").orderBy("k").collect()] == list(range(0, 20, 2))
    assert sampling.stride_sample(df, 1.0, "k").count() == 20


def test_noise_without_room_is_empty_and_repeatable(spark):
    gt = spark.createDataFrame([(1, i, 2, 0.5, 0.5, 0.2, 0.2) for i in range(5)], "image_id long, gt_id long, label long, cx double, cy double, w double, h double")
    assert sampling.noise_annotations(gt, number=3).count() == 0
    a, b = (sampling.noise_annotations(gt, number=20, seed=4).orderBy("slot").collect() for _ in range(2))
    assert a == b and len(a) == 20 and [r["slot"] for r in a] == list(range(20))
    assert all(0 <= r[c] <= 1 for r in a for c in ("cx", "cy", "w", "h"))


def test_activations(spark):
    row = spark.createDataFrame([(2.0, 1.0)], "x double, t double").select(act.bce_with_logits(F.col("x"), F.col("t")).alias("b"), act.softplus(-F.col("x")).alias("s"), act.inverse_sigmoid(F.lit(2.0)).alias("i")).first()
    assert row["b"] == pytest.approx(row["s"]) and row["i"] == pytest.approx(math.log(1 / 1e-5))


def coco_loop(gt, det, t, lo, hi):
    """(hits, ignored) of one image and category by the public rules: gt and det are (id, box, crowd or score)."""
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    skip = {g: bool(crowd) or not lo <= size(b) <= hi for g, b, crowd in gt}
    used, hits, ignored = set(), set(), set()
    for d, box, _ in sorted(det, key=lambda x: (-x[2], x[0])):
        found = []
        for g, b, crowd in gt:
            w, h = min(box[2], b[2]) - max(box[0], b[0]), min(box[3], b[3]) - max(box[1], b[1])
            inter = max(0.0, w) * max(0.0, h)
            v = inter / (size(box) if crowd else size(box) + size(b) - inter)
            if round(v, 12) >= t and (crowd or g not in used):
                found.append((skip[g], -round(v, 12), g, crowd))
        if found:
            out, _, g, crowd = min(found)
            used |= set() if crowd else {g}
            (ignored if out else hits).add(d)
        elif not lo <= size(box) <= hi:
            ignored.add(d)
    return hits, ignored


def test_matches_by_area_equal_a_loop(spark):
    rng = random.Random(21)
    box = lambda: (lambda x, y, s: [x, y, x + s, y + s])(float(rng.randrange(0, 120)), float(rng.randrange(0, 120)), float(rng.choice([20, 31, 32, 60, 96, 120])))
    gt = [(i, box(), int(i % 6 == 0)) for i in range(30)]
    det = [(100 + i, [v + rng.randrange(-4, 5) for v in gt[i % 30][1]], rng.randrange(8) / 8) for i in range(70)]
    frame = lambda rows, key, last: spark.createDataFrame([(1, 2, k, *b, v, (b[2] - b[0]) * (b[3] - b[1])) for k, b, v in rows], f"image_id long, category_id int, {key} long, x0 double, y0 double, x1 double, y1 double, {last}, area double")
    g, d = frame(gt, "gt_id", "iscrowd int"), frame(det, "det_id", "score double")
    got = coco.expanded(coco.matched(matching.box_pairs(g, d), d, g, (0.5, 0.75)), (0.5, 0.75)).collect()
    assert len(got) == 70 * 4 * 2
    for name, (lo, hi) in coco.AREAS.items():
        for t in (0.5, 0.75):
            hits, ignored = coco_loop(gt, det, t, lo, hi)
            mine = [r for r in got if r["range"] == name and r["t"] == t]
            assert {r["det_id"] for r in mine if r["tp"]} == hits and {r["det_id"] for r in mine if r["ignored"]} == ignored
    few = coco.matched(matching.box_pairs(g, d), d, g, (0.5,), most=10).collect()
    assert {r["det_id"] for r in few} == {k for k, _, _ in sorted(det, key=lambda x: (-x[2], x[0]))[:10]}
    per = coco.by_category(coco.matched(matching.box_pairs(g, d), d, g), coco.truths(g))
    rows = {r["metric"]: r["value"] for r in coco.summary(per).collect()}
    assert list(rows) == ["AP", "AP50", "AP75", "APs", "APm", "APl", "AR1", "AR10", "AR100", "ARs", "ARm", "ARl"]
    assert 0 < rows["AP75"] <= rows["AP50"] <= 1 and rows["AR1"] <= rows["AR10"] <= rows["AR100"]
    none = coco.by_category(coco.matched(matching.box_pairs(g, d), d, g), coco.truths(g.filter("area < 0")))
    assert {r["value"] for r in coco.summary(none).collect()} == {-1.0}


def test_numbers_run_over_range_partitions(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.concat(F.lit("g"), F.col("id") % 37).alias("g")).repartition(5)
    assert [r["n"] for r in ordering.numbered(df, ["k"], "n").orderBy("k").collect()] == list(range(500))
    want = {k: i for i, (_, k) in enumerate(sorted((r["g"], r["k"]) for r in df.collect()), 1)}
    assert {r["k"]: r["n"] for r in ann.global_numbers(df, "g", "k", "n").collect()} == want
    assert ordering.numbered(df.limit(0), ["k"], "n").count() == 0 and ann.global_numbers(df.limit(0), "g", "k", "n").count() == 0


def test_boundary_distance_by_image(spark):
    rng = random.Random(3)
    mask = {(i, y, x) for i in range(3) for y in range(12) for x in range(12) if rng.random() < 0.93}
    px = spark.createDataFrame(sorted(mask), "image_id long, y long, x long")
    got = {tuple(r) for r in rasters.boundary_band(px, ["image_id"], (F.col("image_id") + 1).cast("int")).select("image_id", "y", "x").collect()}
    want = {(i, y, x) for i, y, x in mask if any((i, y + a, x + b) not in mask for a in range(-i - 1, i + 2) for b in range(-i - 1, i + 2))}
    assert got == want
    sizes = spark.createDataFrame([(8, 8), (480, 640)], "h int, w int").select(rasters.boundary_distance(F.col("h"), F.col("w")).alias("d"))
    assert [r["d"] for r in sizes.collect()] == [1, 16]


def test_semantic_labels_equal_the_long_form(spark):
    rng = random.Random(14)
    cls = spark.createDataFrame([(i, q, c, rng.uniform(-3, 3)) for i in range(2) for q in range(3) for c in (1, 4, 7)], "image_id long, q long, c long, logit double")
    mask = spark.createDataFrame([(i, q, y, x, rng.uniform(-3, 3)) for i in range(2) for q in range(3) for y in range(4) for x in range(4)], "image_id long, q long, y long, x long, logit double")
    sig = lambda v: 1 / (1 + math.exp(-v))
    want = defaultdict(float)
    for a in cls.collect():
        for m in mask.filter((F.col("image_id") == a["image_id"]) & (F.col("q") == a["q"])).collect():
            want[a["image_id"], m["y"], m["x"], a["c"]] += sig(a["logit"]) * sig(m["logit"])
    scores = decode.semantic_scores(cls, mask)
    assert {(r["image_id"], r["y"], r["x"], r["c"]): r["score"] for r in scores.collect()} == pytest.approx(dict(want))
    labels = sorted(tuple(r) for r in decode.semantic_labels(cls, mask).collect())
    assert labels == sorted((r["image_id"], r["y"], r["x"], r["label"]) for r in decode.argmax_label(scores).collect())


def test_checks_and_branches(spark):
    over = spark.createDataFrame([(1, 0, 3, 5), (1, 0, 255, 2), (2, 1, 1, 4)], "image_id long, gt long, pred long, n long")
    known = spark.createDataFrame([(1,), (255,)], "category_id long")
    assert sorted(tuple(r) for r in metrics.unknown_predictions(over, known, 255).collect()) == [(1, 3, 5), (1, 255, 2)]
    one = spark.createDataFrame([(0.5,)], "loss double")
    got = metrics.merged_branches({("", None): one, ("interm", None): one, ("dn", 3): one}).collect()
    assert [(r["metric"], r["branch"], r["layer"]) for r in got] == [("loss", "", None), ("loss_interm", "interm", None), ("loss_dn_3", "dn", 3)]
