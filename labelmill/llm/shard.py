"""Uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows lie in G logical parts (by a hash of the row, so a retried task finds the same rows). How many rows of each
part go to each shard is drawn exactly: a uniform permutation of all rows gives each part a multivariate
hypergeometric count, drawn part by part from the sizes alone. Each part permutes its rows locally and hands out
consecutive runs of them, the rows are exchanged, and every shard permutes what it received: within bounded
sub-ranges of a second random order, whose counts give each sub-range its first slot.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

#: Rows that one window of the first and of the second permutation has on average, and the most parts.
ROWS_PER_PART, MOST_PARTS = 512, 1 << 16


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of `draws` rows drawn without replacement from good + bad rows are good; exact for any sizes.

    The mass function is walked outward from its mode, so the work grows with the standard deviation."""
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    total = good + bad
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    up = down = mass = 1.0
    up_at = down_at = mode
    points = [(mode, 1.0)]
    while True:
        grown = False
        if up_at < high:
            up *= (good - up_at) * (draws - up_at) / ((up_at + 1) * (bad - draws + up_at + 1))
            up_at += 1
            if up > 1e-18:
                points.append((up_at, up))
                mass += up
                grown = True
            else:
                up_at = high
        if down_at > low:
            down *= down_at * (bad - draws + down_at) / ((good - down_at + 1) * (draws - down_at + 1))
            down_at -= 1
            if down > 1e-18:
                points.append((down_at, down))
                mass += down
                grown = True
            else:
                down_at = low
        if not grown and up_at >= high and down_at <= low:
            break
    target = rng.random() * mass
    for at, weight in points:
        target -= weight
        if target <= 0:
            return at
    return mode


def communication_matrix(part_sizes: list[int], shard_sizes: list[int], seed: int) -> list[list[int]]:
    """Rows of each part for each shard: row sums are the part sizes, column sums the shard sizes, exactly."""
    rng, left, out = random.Random(seed), list(shard_sizes), []
    for size in part_sizes:
        row, draws, rest = [], size, sum(left)
        for s, room in enumerate(left):
            rest -= room
            take = hypergeometric(rng, room, rest, draws)
            row.append(take)
            draws -= take
        left = [a - b for a, b in zip(left, row)]
        out.append(row)
    return out


def _unit(key: Column, salt: int, seed: int) -> Column:
    return F.xxhash64(key, F.lit(salt), F.lit(seed))


def shard_rows(df: DataFrame, key: str, shards: int, seed: int = 17, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """df with `shard` int (0 to shards-1, counts at most one apart) and `slot` long (gapless from 0 in its shard).

    Rows are placed by a hash of the key and of all other columns that can be hashed (no maps), so one key of very many
    rows, null too, is spread like any other; only rows equal in all of these share a part. Repeated rows each get a slot
    of their own. An empty table gives no rows. Columns of df called shard or slot are replaced, all others stay, whatever
    their names. The same table, key and seed give the same shards. Only counts reach the driver: one number a part (at
    most 65,536 of them), and one a sub-range of a shard."""
    df = df.drop("shard", "slot")
    part_, at_, ends_, range_, first_, own_, row_ = (unused(df, f"{n}_") for n in ("part", "at", "ends", "range", "first", "own", "row"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name != key and not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    columns = [*(F.col(f"`{c}`") for c in df.columns), "shard", "slot"]
    df = df.withColumn(row_, F.xxhash64(F.col(f"`{key}`"), *hashed, F.lit(seed)))
    total = df.count()
    parts = max(1, min(MOST_PARTS, -(-total // rows_per_part)))
    row = F.col(row_)
    part = F.pmod(_unit(row, 1, seed), F.lit(parts)).cast("int")
    counted = {r[part_]: r["n"] for r in df.select(part.alias(part_)).groupBy(part_).agg(F.count("*").alias("n")).collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    order = sorted(counted)
    rows = []
    for p, drawn in zip(order, communication_matrix([counted[p] for p in order], sizes, seed)):
        ends = [sum(drawn[: s + 1]) for s in range(shards)]
        rows.append((p, ends))
    matrix = df.sparkSession.createDataFrame(rows, f"{part_} int, {ends_} array<bigint>")  # at most 65,536 short rows
    local = Window.partitionBy(part_).orderBy(_unit(row, 2, seed), row)

    def sent(frame: DataFrame) -> DataFrame:
        """Each row's shard, and the sub-range of the shard's second permutation that it falls in."""
        spread = F.pmod(_unit(row, 3, seed), F.lit(max(1, -(-parts // shards)))).cast("int")
        return (
            frame.withColumn(part_, part).withColumn(at_, F.row_number().over(local))
            .join(F.broadcast(matrix), part_)
            .withColumn("shard", F.size(F.filter(ends_, lambda e: e < F.col(at_))))
            .withColumn(range_, spread).drop(part_, at_, ends_)
        )

    ranges = sent(df.select(row_)).groupBy("shard", range_).agg(F.count("*").alias("n")).collect()
    first, seen = [], {}
    for r in sorted(ranges, key=lambda r: (r["shard"], r[range_])):
        first.append((r["shard"], r[range_], seen.get(r["shard"], 0)))
        seen[r["shard"]] = seen.get(r["shard"], 0) + r["n"]
    starts = df.sparkSession.createDataFrame(first, f"shard int, {range_} int, {first_} bigint")
    again = Window.partitionBy("shard", range_).orderBy(_unit(row, 4, seed), row)
    return (
        sent(df).withColumn(own_, F.row_number().over(again)).join(F.broadcast(starts), ["shard", range_])
        .withColumn("slot", F.col(first_) + F.col(own_) - 1).select(*columns)
    )
