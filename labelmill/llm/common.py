"""Helpers shared by the corpus operators: scratch tables, grouped batches and hashed words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def land(df: DataFrame) -> DataFrame:
    """Write df once to the shared scratch folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def keyed_join(rows: DataFrame, table: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """rows joined to a table that has one row a key. Keys with more than a 1/share of all rows, of which there are fewer
    than share, are joined by broadcast, so no task gets all rows of a very frequent key; the others are shuffled."""
    per = land(rows.groupBy(*keys).agg(F.count("*").alias("n_")))
    total = per.agg(F.sum("n_")).first()[0] or 0
    often = F.broadcast(per.filter(F.col("n_") > total / share).select(*keys))
    hot = rows.join(F.broadcast(table.join(often, keys, "left_semi")), keys)
    return hot.unionByName(rows.join(often, keys, "left_anti").join(table, keys))


def discard(df: DataFrame) -> None:
    """Remove a landed table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """From batches sorted by integer keys, tables that never split a group; many small groups share one table."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        cuts = np.flatnonzero(change)
        if not len(cuts):
            held.append(batch)
            continue
        if held or cuts[-1]:
            yield pa.Table.from_batches([*held, batch.slice(0, int(cuts[-1]))])
        held = [batch.slice(int(cuts[-1]))]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(tab: pa.Table, keys: list[str]) -> np.ndarray:
    """Row offsets of the groups of consecutive equal keys, with the end."""
    change = np.zeros(tab.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        v = tab.column(k).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(change), tab.num_rows)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = column.type in (pa.large_string(), pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets.astype(np.int64) - int(offsets[0])


def byte_chunks(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows a..b with their bytes, about `most` bytes at a time; one longer text makes a chunk of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODE = np.random.default_rng(20240501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a xorshift-multiply finaliser)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` (A-Z lower-cased) of each text, and each text's word offsets."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SEPARATOR[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    starts = offsets[:-1][offsets[:-1] < n]
    first[starts] |= inside[starts]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] |= inside[ends]
    power, inverse = _power_tables(n)
    sums = np.empty(n + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_CODE[_LOWER[data]] * power, out=sums[1:])
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64))
    return h, np.searchsorted(a, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each text, and their offsets.

    A text of fewer words has its whole sequence as its one shingle; without words its set is empty."""
    words, at = hashed_words(data, offsets)
    count = np.diff(at)
    full = np.zeros(len(words), dtype=np.uint64)
    for j in range(width):
        odd = np.uint64((0xD6E8FEB86659FD93 * (2 * j + 3)) % 2**64 | 1)
        n = max(0, len(words) - j)  # none where all texts together have fewer words
        full[:n] += words[j : j + n] * odd
    full = mix(full)
    rank = np.arange(len(words)) - np.repeat(at[:-1], count)
    whole = np.repeat(count, count)
    keep = rank + width <= whole
    for i in np.flatnonzero((count > 0) & (count < width)):
        value = np.array([count[i]], dtype=np.uint64)
        for j in range(at[i], at[i + 1]):
            value = mix(value * np.uint64(31) + words[j : j + 1])
        full[at[i]], keep[at[i]] = value[0], True
    sizes = np.add.reduceat(np.append(keep, False).astype(np.int64), at[:-1]) * (count > 0) if len(count) else count
    flat, off = full[keep], np.append(0, np.cumsum(sizes))
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        if b - a > 1:
            flat[a:b].sort()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[off[:-1][off[:-1] < len(flat)]] = True
    return flat[new], np.append(0, np.cumsum(new))[off]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
