"""Frame streams: scoring, in-order release, windowed reports and tracking. Each works on a stream as on a table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import matching


def score_stream(frames: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The same function of a DataFrame for a table and for a stream."""
    return score(frames)


def windowed_counts(frames: DataFrame, threshold: float, window: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Raw and kept (score > threshold) rows of each stream and tumbling window; late rows are dropped after `delay`."""
    timed = frames.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, delay) if frames.isStreaming else timed
    return timed.groupBy(F.window(time, window).alias("w"), "stream_id").agg(F.count("*").alias("raw"), F.count_if(F.col("score") > threshold).alias("kept")).select(F.col("w.start").alias("start"), "stream_id", "raw", "kept")


def windowed_latency(frames: DataFrame, window: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Latency figures of tumbling windows; an exact median is for tables only."""
    timed = frames.withColumn(time, F.col(time).cast("timestamp"))
    timed = timed.withWatermark(time, delay) if frames.isStreaming else timed
    v = F.col("latency_ms")
    return timed.groupBy(F.window(time, window).alias("w")).agg(F.count("*").alias("n"), F.avg(v).alias("mean_ms"), F.stddev_samp(v).alias("sd_ms"), F.min(v).alias("min_ms"), F.max(v).alias("max_ms")).select(F.col("w.start").alias("start"), "n", "mean_ms", "sd_ms", "min_ms", "max_ms")


#: A stream's state: the next frame to release, how many were, and the frames that wait, sorted, with their event times.
_ORDER_STATE = "next long, released long, idx array<bigint>, at array<bigint>, payload array<string>"
_ORDERED = "stream_id long, frame_idx long, payload string, place long"


def _ordered(patience: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_, released, idx, at, payload = state.get if state.exists else (0, 0, [], [], [])
        waiting = {i: (t, p) for i, t, p in zip(idx, at, payload)}
        if not state.hasTimedOut:
            for pdf in batches:
                for i, t, p in zip(pdf["frame_idx"].tolist(), pdf["at"].tolist(), pdf["payload"].tolist()):
                    if i >= next_:
                        waiting.setdefault(i, (t, p))  # a repeated frame, or one whose turn has passed, is dropped
        now, order, out = state.getCurrentWatermarkMs(), sorted(waiting), []
        for i in order:
            # frames follow each other; a gap is skipped once the watermark is `patience` beyond the first frame after it
            if i != next_ and waiting[i][0] + patience > now:
                break
            out.append((key[0], i, waiting.pop(i)[1], released))
            next_, released = i + 1, released + 1
        order = order[len(out) :]
        state.update((next_, released, order, [waiting[i][0] for i in order], [waiting[i][1] for i in order]))
        if order:
            state.setTimeoutTimestamp(max(waiting[order[0]][0] + patience, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "payload", "place"])

    return step


def in_order(frames: DataFrame, patience: int = 10_000, delay: str = "10 seconds", time: str = "ts") -> DataFrame:
    """(stream_id, frame_idx, payload, place) of (stream_id, frame_idx, payload, event time), released in order of
    frame_idx for each stream, from 0; `place` counts what was released before.

    A frame waits until all before it came, or until the watermark has passed the event time of the first waiting frame
    by `patience` ms; then the gap is skipped, and what comes for it later is dropped. The watermark is `delay` behind the
    newest event of all streams; Spark drops frames that are older, so `delay` must cover how much out of order frames come. The state of a stream is one list of waiting frames, read and written once a micro-batch, and timers run on event
    time, so a query that reads all there is ends. In a table, which is complete, no frame waits."""
    rows = frames.select("stream_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("payload").cast("string").alias("payload"), F.col(time).cast("timestamp").alias("_t"))
    if not frames.isStreaming:
        once = rows.filter("frame_idx >= 0").dropDuplicates(["stream_id", "frame_idx"])
        return once.select("stream_id", "frame_idx", "payload", (F.row_number().over(Window.partitionBy("stream_id").orderBy("frame_idx")) - 1).cast("long").alias("place"))
    timed = rows.withWatermark("_t", delay).withColumn("at", F.unix_millis("_t"))
    return timed.groupBy("stream_id").applyInPandasWithState(_ordered(patience), _ORDERED, _ORDER_STATE, "append", GroupStateTimeout.EventTimeTimeout)


class Tracker:
    """The tracks of one stream: each frame's boxes take tracks by least-cost assignment; tracks live on unseen for a while."""

    def __init__(self, least: float, age: int, count: int = 0, done: int = -1, tracks: Iterable[tuple] = ()):
        self.least, self.age, self.count, self.done = least, age, count, done
        self.tracks = [list(t) for t in tracks]  # number, frame last seen, x0, y0, x1, y1

    def frame(self, number: int, boxes: np.ndarray) -> list[int]:
        """The tracks of a frame's boxes (n x 4); a pair below `least` overlap is never assigned."""
        self.tracks = [t for t in self.tracks if number - t[1] <= self.age + 1]
        old = np.array([t[2:] for t in self.tracks], float).reshape(-1, 4)
        out = [-1] * len(boxes)
        if len(old) and len(boxes):
            side = np.minimum(boxes[:, None, 2:], old[None, :, 2:]) - np.maximum(boxes[:, None, :2], old[None, :, :2])
            inter = side.clip(0).prod(2)
            size = lambda b: (b[:, 2:] - b[:, :2]).prod(1)
            whole = size(boxes)[:, None] + size(old)[None, :] - inter
            iou = np.divide(inter, whole, out=np.zeros_like(inter), where=whole > 0)
            cost = np.where(iou >= self.least, 1 - iou, 2.0)
            flip = len(boxes) > len(old)
            cols = matching.shortest_augmenting_paths(cost.T if flip else cost)
            for b, t in zip(*((cols, range(len(cols))) if flip else (range(len(cols)), cols))):
                if iou[b, t] >= self.least:
                    out[b] = t
        for b, t in enumerate(out):
            if t < 0:
                self.tracks.append([self.count, number, *boxes[b]])
                out[b], self.count = self.count, self.count + 1
            else:
                self.tracks[t][1:] = [number, *boxes[b]]
                out[b] = self.tracks[t][0]
        self.done = number
        return out


_TRACK_STATE = "count long, done long, tracks array<struct<number:bigint,seen:bigint,x0:double,y0:double,x1:double,y1:double>>, held array<struct<frame:bigint,det:bigint,at:bigint,x0:double,y0:double,x1:double,y1:double>>"
_TRACKED = "stream_id long, frame_idx long, det_id long, track long"
_SIDES = ("x0", "y0", "x1", "y1")


def _frames(stream: int, tracker: Tracker, rows: list[tuple]) -> list[tuple]:
    """(stream, frame, det, track) of whole frames given as (frame, det, ..., x0, y0, x1, y1) rows."""
    out = []
    for number, group in groupby(sorted(rows), key=lambda r: r[0]):
        boxes = list(group)
        found = tracker.frame(number, np.array([b[-4:] for b in boxes], float))
        out += [(stream, number, b[1], t) for b, t in zip(boxes, found)]
    return out


def _tracked(least: float, age: int, patience: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, done, tracks, held = state.get if state.exists else (0, -1, [], [])
        tracker = Tracker(least, age, count, done, (tuple(t) for t in tracks))
        rows = {(r[0], r[1]): tuple(r) for r in map(tuple, held)}
        if not state.hasTimedOut:
            for pdf in batches:
                for r in pdf[["frame_idx", "det_id", "at", *_SIDES]].itertuples(index=False, name=None):
                    if r[0] > done:
                        rows.setdefault(r[:2], r)
        now = state.getCurrentWatermarkMs()
        newest = max((r[0] for r in rows.values()), default=-1)
        # a frame is whole once a later one has begun, or the watermark is `patience` beyond it
        whole = [r for r in rows.values() if r[0] < newest]
        last = [r for r in rows.values() if r[0] == newest]
        if last and max(r[2] for r in last) + patience <= now:
            whole, last = whole + last, []
        out = _frames(key[0], tracker, whole)
        state.update((tracker.count, tracker.done, [tuple(float(v) if k > 1 else int(v) for k, v in enumerate(t)) for t in tracker.tracks], last))
        if last:
            state.setTimeoutTimestamp(max(max(r[2] for r in last) + patience, now + 1))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "frame_idx", "det_id", "track"])

    return step


def _tracked_table(batches: Iterable[pa.RecordBatch], least: float, age: int) -> Iterator[pa.RecordBatch]:
    """The same for whole streams, sorted by stream and frame."""
    stream, tracker, held = None, None, []

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=["stream_id", "frame_idx", "det_id", "track"])

    for batch in batches:
        done = []
        for s, *r in zip(*(batch.column(c).to_pylist() for c in ("stream_id", "frame_idx", "det_id", *_SIDES))):
            if held and (s, r[0]) != (stream, held[0][0]):
                done += _frames(stream, tracker, held)
                held = []
            if tracker is None or s != stream:
                stream, tracker = s, Tracker(least, age)
            held.append(tuple(r))
        yield out(done)
    if held:
        yield out(_frames(stream, tracker, held))


def track(frames: DataFrame, least: float = 0.5, age: int = 0, patience: int = 0, delay: str = "10 seconds", time: str = "ts") -> DataFrame:
    """(stream_id, frame_idx, det_id, track) for boxes (stream_id, frame_idx, det_id, x0..y1, event time) of streams whose
    frames come in order.

    The boxes of a frame are assigned to the stream's tracks at least total cost (1 - IoU, pairs below `least` never); a
    box without a track begins one, and a track that no box of `age` frames in a row took (by their numbers) ends. A frame
    may be split over micro-batches: it is held until a row of a later frame comes or the watermark (`delay`
    behind the newest event) is `patience` ms beyond it; rows of frames already tracked, and repeated (frame, det_id), are dropped. A stream's state is its tracks and the frame held."""
    rows = frames.select("stream_id", F.col("frame_idx").cast("long").alias("frame_idx"), F.col("det_id").cast("long").alias("det_id"), *[F.col(c).cast("double").alias(c) for c in _SIDES], *([F.col(time).cast("timestamp").alias("_t")] if frames.isStreaming else []))
    if not frames.isStreaming:
        once = rows.dropDuplicates(["stream_id", "frame_idx", "det_id"]).repartition("stream_id").sortWithinPartitions("stream_id", "frame_idx", "det_id")
        return once.mapInArrow(lambda it: _tracked_table(it, least, age), _TRACKED)
    timed = rows.withWatermark("_t", delay).withColumn("at", F.unix_millis("_t"))
    return timed.groupBy("stream_id").applyInPandasWithState(_tracked(least, age, patience), _TRACKED, _TRACK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def drained(stream: DataFrame, folder: Callable[[], str]) -> DataFrame:
    """All that an append-mode stream gives until its source has nothing more, as a table in a folder that folder() names."""
    out, state = folder(), folder()
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
