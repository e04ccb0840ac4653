"""A stream gives what the table gives; order is restored; tracks persist."""

import itertools
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from labelmill.streaming import frames as S


def drained(df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, rows, schema, tmp_path, files=3):
    path = str(tmp_path / "in")
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def test_windowed_reports(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i % 3, i, t0 + timedelta(minutes=i), float(i % 10), (i % 10) / 10) for i in range(300)]
    stream, table = source(spark, rows, "stream_id long, frame_idx long, ts timestamp, latency_ms double, score double", tmp_path)
    counts = drained(S.windowed_counts(stream, 0.5, delay="1 day"), "counts", tmp_path, "update")
    last = counts.groupBy("start", "stream_id").agg(F.max("raw").alias("raw"), F.max("kept").alias("kept"))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, S.windowed_counts(table, 0.5).collect()))
    assert S.windowed_latency(table).count() == 5
    assert S.score_stream(table, lambda df: df.filter("score > 0.5")).count() == 120


def ordered(rows):
    """{stream: [(frame, payload)]} of complete or repeated frames."""
    out = {}
    for s, i, p, *_ in rows:
        out.setdefault(s, {}).setdefault(i, p)
    return {s: sorted(v.items()) for s, v in out.items()}


def test_frames_are_released_in_order(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(s, i, f"{s}:{i}", t0 + timedelta(seconds=i)) for s in range(3) for i in range(20)]
    random.Random(1).shuffle(rows)
    rows += rows[:5]  # repeated frames
    stream, table = source(spark, rows, "stream_id long, frame_idx long, payload string, ts timestamp", tmp_path)
    for out in (drained(S.in_order(stream, patience=10**9, delay="1 day"), "ordered", tmp_path), S.in_order(table)):
        got = out.collect()
        assert len(got) == 60 and all(r["place"] == r["frame_idx"] and r["payload"] == f"{r['stream_id']}:{r['frame_idx']}" for r in got)


def test_a_gap_is_skipped_once_the_watermark_has_passed_it(spark, tmp_path):
    """Frame 2 of stream 1 comes too late; stream 2 still waits for its frame 1 when all has been read."""
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    path = str(tmp_path / "gaps")
    schema = "stream_id long, frame_idx long, payload string, ts timestamp"
    for k, rows in enumerate([[(1, 0, "a", t(0)), (1, 1, "b", t(1)), (1, 3, "d", t(3))], [(1, 4, "e", t(60))], [(1, 2, "c", t(2)), (1, 5, "f", t(61)), (2, 0, "x", t(62)), (2, 2, "z", t(62))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    got = drained(S.in_order(stream, patience=10_000, delay="0 seconds"), "gap", tmp_path).orderBy("stream_id", "place").collect()
    assert [(r["stream_id"], r["payload"], r["place"]) for r in got] == [(1, "a", 0), (1, "b", 1), (1, "d", 2), (1, "e", 3), (1, "f", 4), (2, "x", 0)]


def best_tracks(frames, least, age):
    """Tracks by trying every assignment: {(frame, det): track}."""
    tracks, out, count = {}, {}, 0

    def iou(a, b):
        inter = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return inter / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter)

    for f, boxes in sorted(frames.items()):
        tracks = {k: v for k, v in tracks.items() if f - v[0] <= age + 1}
        dets, names = sorted(boxes), sorted(tracks)
        best = None
        for pick in itertools.product([None, *names], repeat=len(dets)):
            used = [p for p in pick if p is not None]
            values = [iou(boxes[d], tracks[p][1]) for d, p in zip(dets, pick) if p is not None]
            if len(set(used)) == len(used) and all(v >= least for v in values):
                cost = sum(1 - v for v in values) + 2 * (min(len(dets), len(names)) - len(used))
                best = min(best or (9e9, ()), (cost, pick), key=lambda x: x[0])
        for d, p in zip(dets, best[1]):
            if p is None:
                p, count = count, count + 1
            tracks[p], out[f, d] = (f, boxes[d]), p
    return out


def test_tracks_equal_the_best_assignments(spark, tmp_path):
    """Boxes that move at random, vanish for some frames and cross; frames split over micro-batches; the last one is held."""
    rng = random.Random(4)
    t0, rows, frames = datetime(2024, 1, 1), [], {}
    for s in range(3):
        at = [[rng.uniform(0, 60), rng.uniform(0, 20)] for _ in range(4)]
        for f in range(25):
            for d in range(4):
                at[d] = [v + rng.uniform(-6, 6) for v in at[d]]
                if rng.random() < 0.75:
                    box = (at[d][0], at[d][1], at[d][0] + 20, at[d][1] + 15)
                    rows.append((s, f, d, *box, t0 + timedelta(seconds=f)))
                    frames.setdefault(s, {}).setdefault(f, {})[d] = box
    schema = "stream_id long, frame_idx long, det_id long, x0 double, y0 double, x1 double, y1 double, ts timestamp"
    path = str(tmp_path / "boxes")
    rows.sort(key=lambda r: r[1])
    for k in range(4):  # the cuts fall inside frames
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part + part[:2], schema).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    got = {(r["stream_id"], r["frame_idx"], r["det_id"]): r["track"] for r in drained(S.track(stream, 0.3, 2, patience=10**9), "tracks", tmp_path).collect()}
    whole = {(r["stream_id"], r["frame_idx"], r["det_id"]): r["track"] for r in S.track(spark.createDataFrame(rows, schema).repartition(5), 0.3, 2).collect()}
    want = {(s, f, d): t for s, fs in frames.items() for (f, d), t in best_tracks(fs, 0.3, 2).items()}
    assert whole == want
    assert got == {k: v for k, v in want.items() if k[1] < max(frames[k[0]])}
    assert len(set(want.values())) > 4
