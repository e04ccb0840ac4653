"""Average precision and recall of detections by area range and number of detections, as the public COCO rules define them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import land
from . import matching, ordering

KEYS = ["image_id", "category_id"]
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
#: Areas in pixels (both ends belong to a range), detections of an image and category that count.
AREAS = {"all": (0.0, 1e10), "small": (0.0, 1024.0), "medium": (1024.0, 9216.0), "large": (9216.0, 1e10)}
MAX_DETS = (1, 10, 100)


def _outside(areas: Mapping[str, tuple[float, float]], width: int) -> Column:
    """The settings (`width` bits for each range) of the ranges that the column `area` lies outside of."""
    every = (1 << width) - 1
    out = [F.when((F.col("area") < float(lo)) | (F.col("area") > float(hi)), F.lit(every << (k * width))).otherwise(F.lit(0)) for k, (lo, hi) in enumerate(areas.values())]
    return sum(out[1:], out[0]).cast("bigint")


def ranked(det: DataFrame, thresholds: Sequence[float] = THRESHOLDS, areas: Mapping[str, tuple[float, float]] = AREAS, most: int = max(MAX_DETS)) -> DataFrame:
    """The `most` best detections of each image and category, with `rank` and `outside` (settings whose range they lie outside of)."""
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col("score").desc(), "det_id"))
    return det.withColumn("outside", _outside(areas, len(thresholds))).withColumn("rank", rank).filter(F.col("rank") <= most)


def matched(pairs: DataFrame, det: DataFrame, gt: DataFrame, thresholds: Sequence[float] = THRESHOLDS, areas: Mapping[str, tuple[float, float]] = AREAS, most: int = max(MAX_DETS)) -> DataFrame:
    """Every detection among the `most` best of its image and category: keys, det_id, score, rank, and as bit sets over
    settings where it is a true positive (`tp`) and where it is ignored (`ignored`). A setting is an area range and a
    threshold: bit number of the range * thresholds + number of the threshold.

    pairs: as from matching.box_pairs or runs.mask_pairs; det: keys, det_id, score, area; gt: keys, gt_id, area, iscrowd.
    Where `det` comes from `ranked`, the pairs are to come from it too, and pairs with the truth's `area` (runs.close_pairs) need no
    join with `gt`. A truth that is a crowd or outside the range is matched last and the detection that takes it is ignored; so is an
    unmatched detection outside the range."""
    n = len(thresholds)
    own = "rank" in det.columns
    best = (det if own else ranked(det, thresholds, areas, most)).select(*KEYS, "det_id", "score", "outside", "rank")
    met = pairs.filter(F.col("v") >= float(min(thresholds)))
    if not own:
        met = met.join(best.select(*KEYS, "det_id"), [*KEYS, "det_id"], "left_semi")
    if "area" in pairs.columns:
        met = met.withColumn("skip", _outside(areas, n))
    else:
        met = met.join(gt.select(*KEYS, "gt_id", _outside(areas, n).alias("skip")), [*KEYS, "gt_id"])
    repeated = sum(1 << (k * n) for k in range(len(areas)))
    left = matching.threshold_bits(F.col("v"), thresholds) * F.lit(repeated)
    met = met.withColumns({"left": left, "skip": F.when(F.col("crowd"), F.lit(-1).cast("bigint")).otherwise(F.col("skip"))})
    won = F.bit_or(F.when(F.col("ignore"), F.lit(0).cast("bigint")).otherwise(F.col("bits")))
    hits = matching.match_rounds(met, KEYS).groupBy(*KEYS, "det_id").agg(won.alias("tp"), F.bit_or("bits").alias("any"))
    none = F.lit(0).cast("bigint")
    out = best.join(hits, [*KEYS, "det_id"], "left").withColumns({"tp": F.coalesce("tp", none), "any": F.coalesce("any", none)})
    ignored = F.col("any").bitwiseAND(F.bitwise_not("tp")).bitwiseOR(F.col("outside").bitwiseAND(F.bitwise_not("any")))
    return out.select(*KEYS, "det_id", "score", "rank", "tp", ignored.alias("ignored"))


def _settings(thresholds: Sequence[float], areas: Iterable[str]) -> list[tuple[str, float]]:
    return [(r, float(t)) for r in areas for t in thresholds]


def expanded(found: DataFrame, thresholds: Sequence[float] = THRESHOLDS, areas: Iterable[str] = tuple(AREAS)) -> DataFrame:
    """`matched` as rows: keys, range, t, det_id, score, rank, tp (0 or 1), ignored."""
    each = ",".join(f"struct('{r}' as range,{t!r}D as t,cast(shiftright(tp,{i})&1 as int) as tp,(shiftright(ignored,{i})&1)=1 as ignored)" for i, (r, t) in enumerate(_settings(thresholds, areas)))
    return found.selectExpr(*KEYS, "det_id", "score", "rank", f"inline(array({each}))")


def truths(gt: DataFrame, areas: Mapping[str, tuple[float, float]] = AREAS) -> DataFrame:
    """(category_id, range, n_gt): truths that count; categories without any in a range have no row."""
    kept = gt.filter(F.coalesce(F.col("iscrowd"), F.lit(0)) == 0)
    counts = kept.groupBy("category_id").agg(*[F.count_if(F.col("area").between(float(lo), float(hi))).alias(r) for r, (lo, hi) in areas.items()])
    return counts.select("category_id", F.inline(F.array(*[F.struct(F.lit(r).alias("range"), F.col(r).alias("n_gt")) for r in areas]))).filter("n_gt > 0")


def _bits(numbers: pa.Array, n: int) -> np.ndarray:
    return (numbers.to_numpy()[:, None] >> np.arange(n)) & 1


def _counts(batches: Iterable[pa.RecordBatch], n: int, max_dets: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Of rows (category_id, _part, rank, tp, ignored), for each batch, part and setting: true positives, detections that count,
    and true positives up to each number of detections."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.arange(batch.num_rows) == 0
        for c in ("category_id", "_part"):
            v = batch.column(c).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        first = np.flatnonzero(new)
        tp, rank = _bits(batch.column("tp"), n), batch.column("rank").to_numpy()[:, None]
        sums = [np.add.reduceat(c, first).ravel() for c in (tp, 1 - _bits(batch.column("ignored"), n), *(tp * (rank <= m) for m in max_dets))]
        of = pa.array(np.repeat(first, n))
        yield pa.RecordBatch.from_arrays(
            [batch.column("category_id").take(of), batch.column("_part").take(of), pa.array(np.tile(np.arange(n, dtype=np.int32), len(first))), *map(pa.array, sums)],
            names=["category_id", "_part", "i", "h", "k", *(f"hits_{m}" for m in max_dets)],
        )


def _reached(batches: Iterable[pa.RecordBatch], n: int, points: int) -> Iterator[pa.RecordBatch]:
    """(category_id, i, q, p): the highest precision at each recall point that a part of a category reaches.

    Rows come in order. The first one of a part has `start` instead of bits, which is empty elsewhere: for each setting the true
    positives and the counted detections of the parts before it, and the truths."""
    category, best, h, k, truth = None, None, None, None, None

    def ended() -> pa.RecordBatch:
        at = np.flatnonzero(best)
        return pa.RecordBatch.from_arrays([category.take(pa.array(np.zeros(len(at), int))), pa.array((at // points).astype(np.int32)), pa.array((at % points).astype(np.int32)), pa.array(best[at])], names=["category_id", "i", "q", "p"])

    for batch in batches:
        heads = np.flatnonzero(np.diff(batch.column("start").offsets.to_numpy())).tolist()
        for at, end in zip([-1, *heads], [*heads, batch.num_rows]):
            if at >= 0:
                if best is not None:
                    yield ended()
                category, best = batch.column("category_id").slice(at, 1), np.zeros(n * points)
                h, k, truth = np.array(batch.column("start")[at].as_py()).reshape(3, n)
            part = batch.slice(at + 1, end - at - 1)
            if not part.num_rows:
                continue
            tp = _bits(part.column("tp"), n)
            hits, seen = tp.cumsum(axis=0) + h, (1 - _bits(part.column("ignored"), n)).cumsum(axis=0) + k
            h, k = hits[-1], seen[-1]
            r, i = np.nonzero(tp * (truth > 0))
            q = np.floor(hits[r, i] / truth[i] * (points - 1) + 1e-9).astype(np.int64)
            np.maximum.at(best, i * points + q, hits[r, i] / seen[r, i])
    if best is not None:
        yield ended()


def by_category(found: DataFrame, n_gt: DataFrame, thresholds: Sequence[float] = THRESHOLDS, max_dets: Sequence[int] = MAX_DETS, areas: Iterable[str] = tuple(AREAS), points: int = 101) -> DataFrame:
    """(category_id, range, t, n_gt, ap, ar_1, ar_10, ...) for each category, range and threshold with truth.

    `found` as from `matched`: one row a detection. It is landed, so that range partitions of (category, falling score) are sampled from
    rows and not from another matching. Counts of all settings run over the rows of a part side by side, in batches, from what the parts
    before it sum up to, so no task holds a category and nothing is sorted for each setting; of each recall point that true
    positives reach only the highest precision leaves a part."""
    areas, cells = list(areas), _settings(thresholds, areas)
    n = len(cells)
    place = [F.col("score").desc(), F.col("image_id"), F.col("det_id")]
    rows = land(found.select("category_id", "score", "image_id", "det_id", F.col("rank").cast("bigint").alias("rank"), "tp", "ignored").filter("category_id is not null"))
    rows = ordering.ranged(rows, "category_id", *place)
    kind = dict(rows.dtypes)["category_id"]
    sums = ["h", "k", *(f"hits_{m}" for m in max_dets)]
    counted = rows.select("category_id", "_part", "rank", "tp", "ignored").mapInArrow(lambda it: _counts(it, n, max_dets), f"category_id {kind}, _part int, i int, {', '.join(f'{c} bigint' for c in sums)}")
    totals = land(counted.groupBy("category_id", "_part", "i").agg(*[F.sum(c).alias(c) for c in sums]))
    # a part of a category begins with a row of what came before it and of the truths, for each setting
    each = ",".join(f"struct({i} as i,'{r}' as of,{t!r}D as t)" for i, (r, t) in enumerate(cells))
    every = n_gt.selectExpr("category_id", "range", "n_gt", f"explode(array({each})) as c").filter("range = c.of").select("category_id", "range", "n_gt", "c.i", "c.t")
    before = ordering.before_parts(totals, ["category_id", "i"], {"bh": "h", "bk": "k"}).join(F.broadcast(every.select("category_id", "i", "n_gt")), ["category_id", "i"], "left")
    lists = F.array_sort(F.collect_list(F.struct("i", "bh", "bk", F.coalesce("n_gt", F.lit(0)).cast("bigint").alias("g"))))
    start = before.groupBy("category_id", "_part").agg(lists.alias("s")).select("category_id", "_part", F.concat("s.bh", "s.bk", "s.g").alias("start"))
    none = F.array().cast("array<bigint>")  # not null: nulls in lists are slow on their way to Python
    stream = rows.drop("rank").withColumn("start", none).unionByName(start, allowMissingColumns=True).repartition("category_id", "_part")
    stream = stream.sortWithinPartitions("category_id", "_part", F.size("start") == 0, *place)
    reached = stream.select("category_id", "tp", "ignored", "start").mapInArrow(lambda it: _reached(it, n, points), f"category_id {kind}, i int, q int, p double")
    reached = reached.groupBy("category_id", "i", "q").agg(F.max("p").alias("p"))
    # at most `points` rows a setting: the precision of a point is the highest at it or beyond
    setting = Window.partitionBy("category_id", "i")
    beyond = F.max("p").over(setting.orderBy(F.col("q").desc()).rowsBetween(Window.unboundedPreceding, 0))
    since = F.col("q") - F.lag("q", 1, -1).over(setting.orderBy("q"))
    ap = reached.withColumns({"_p": beyond, "_n": since}).groupBy("category_id", "i").agg((F.sum(F.col("_p") * F.col("_n")) / points).alias("ap"))
    hits = totals.groupBy("category_id", "i").agg(*[F.sum(f"hits_{m}").alias(f"hits_{m}") for m in max_dets])
    recall: list[Column] = [(F.coalesce(f"hits_{m}", F.lit(0)) / F.col("n_gt")).alias(f"ar_{m}") for m in max_dets]
    return every.join(ap, ["category_id", "i"], "left").join(hits, ["category_id", "i"], "left").select("category_id", "range", "t", "n_gt", F.coalesce("ap", F.lit(0.0)).alias("ap"), *recall)


def summary(per: DataFrame) -> DataFrame:
    """The twelve numbers (metric, value) of `by_category`: means over categories and thresholds, -1 where none has truth."""
    def mean(column: str, area: str, t: float | None = None) -> Column:
        fits = F.col("range") == area
        return F.coalesce(F.avg(F.when(fits if t is None else fits & (F.col("t") == t), F.col(column))), F.lit(-1.0))

    cells = {
        "AP": mean("ap", "all"), "AP50": mean("ap", "all", 0.5), "AP75": mean("ap", "all", 0.75), "APs": mean("ap", "small"), "APm": mean("ap", "medium"), "APl": mean("ap", "large"),
        "AR1": mean("ar_1", "all"), "AR10": mean("ar_10", "all"), "AR100": mean("ar_100", "all"), "ARs": mean("ar_100", "small"), "ARm": mean("ar_100", "medium"), "ARl": mean("ar_100", "large"),
    }
    row = per.agg(*[c.alias(n) for n, c in cells.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in cells])))
