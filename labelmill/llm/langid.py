"""Language ID by nearest centroid: normalised TF-IDF n-gram vectors against several centroids per language.

The classifier is fitted on a bounded sample of labelled rows; prediction reads every text whole, in one narrow pass.
A short text lies further from any centroid than a long one, so the distance at which a text is rejected depends on how
many n-grams it has: it is taken from the sampled rows and their beginnings of 1, 2, 4, ... words, by size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hashed n-gram features, labelled rows fitted on for each language at most, letters of a fitted row, centroids for each language.
FEATURES, SAMPLE_PER_LANGUAGE, LONGEST_FITTED, CENTROIDS = 1 << 13, 300, 100_000, 3
#: A text is rejected below this share of the least cosine that sampled rows of its size have to their own language.
SLACK = 0.6
#: Sizes of a text: powers of two of its n-grams.
SIZES = 24
UNKNOWN = "und"
_WORD_RUN = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Centroids:
    languages: list[str]
    owner: np.ndarray
    idf: np.ndarray
    vectors: np.ndarray
    limit: np.ndarray  # by size


@lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: 0 if it is no letter, else a mixed hash of it."""
    codes = np.arange(0x110000, dtype=np.uint64)
    spread = (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
    text = "".join(chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x34000))
    letter = np.zeros(0x110000, dtype=bool)
    letter[: len(text)] = np.fromiter(map(str.isalpha, text), dtype=bool, count=len(text))
    return np.where(letter, (spread & np.uint64(0x7FFFFFFF)) + np.uint64(1), 0).astype(np.int64)


def counts(texts: list[str | None]) -> np.ndarray:
    """Hashed counts of letter bigrams and trigrams, word borders included: one row a text."""
    marked = [f" {(t or '').lower()} " for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in marked])
    value = _letters()[np.minimum(codes, 0x10FFFF)]
    keep = value > 0
    keep[1:] |= (value[:-1] > 0) | (doc[1:] != doc[:-1])  # one border after each word, and one at the start
    keep[:1] = True
    value, doc = value[keep], doc[keep]
    out = np.zeros(len(texts) * FEATURES, dtype=np.int64)
    for width in (2, 3):
        if len(value) < width:
            continue
        h = value[: len(value) - width + 1].copy()
        some = h > 0
        for j in range(1, width):
            nxt = value[j : len(value) - width + 1 + j]
            h = (h * 1_000_003 + nxt) & 0x3FFFFFFFFFFF
            some |= nxt > 0
        some &= doc[: len(h)] == doc[width - 1 :]
        bucket = ((h * (2 * width + 0x5851F42D)) >> 17) % FEATURES
        out += np.bincount(doc[: len(h)][some] * FEATURES + bucket[some], minlength=len(out))
    return out.reshape(len(texts), FEATURES)


def _vectors(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(count.astype(np.float32)) * idf
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _text_parts(texts: list[str | None], rows: int = 64, most: int = 1 << 20) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if len(part) >= rows or size > most:
            yield part
            part, size = [], 0
    if part:
        yield part


def _clusters(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with farthest-first starts; the same rows give the same centroids."""
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    centre = x[chosen]
    for _ in range(rounds):
        near = (x @ centre.T).argmax(axis=1)
        rows = [x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(len(centre))]
        centre = np.array(rows, dtype=np.float32)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    return centre


def _size(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(1, count.sum(axis=1))).astype(np.int64), SIZES - 1)


def _beginnings(text: str) -> list[str]:
    words, out, n = text.split(), [text], 1
    while n < len(words):
        out.append(" ".join(words[:n]))
        n *= 2
    return out


def fit(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS, longest: int = LONGEST_FITTED) -> Centroids:
    """Centroids from (doc_id, text, lang): at most `per_language` rows of each language, picked by a hash of id and text.

    Rows without text, lang or any letter, and those of more than `longest` letters, are left out. Only this bounded
    sample reaches the driver; at most 1,000 languages are learned, else ValueError. Null and repeated ids do not matter.
    Without usable rows nothing is learned and every text is rejected."""
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") <= longest) & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).limit(1001).collect()}
    if len(sizes) > 1000:
        raise ValueError("more than 1,000 languages")
    if not sizes:
        return Centroids([], np.zeros(0, int), np.ones(FEATURES, np.float32), np.zeros((0, FEATURES), np.float32), np.zeros(SIZES))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, 1.25 * per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_draw", F.col("doc_id").cast("string")))

    def picked(df: DataFrame) -> list:
        return df.withColumn("_rank", rank).filter(F.col("_rank") <= per_language).select("lang", "text").collect()

    drawn = usable.withColumn("_draw", draw)
    sample = picked(drawn.filter(F.col("_draw") / float(1 << 30) < share[F.col("lang")]))
    missed = sorted(set(sizes) - {r["lang"] for r in sample})  # equal rows are drawn together or not at all
    if missed:
        sample += picked(drawn.filter(F.col("lang").isin(missed)))
    own = {lang: sorted(r["text"] for r in sample if r["lang"] == lang) for lang in sorted({r["lang"] for r in sample})}
    languages, seen, rows = list(own), np.zeros(FEATURES, np.int64), 0
    for texts in own.values():
        for part in _text_parts(texts):
            seen += (counts(part) > 0).sum(axis=0)
            rows += len(part)
    idf = np.log((1 + rows) / (1 + seen)).astype(np.float32) + 1
    owner, vectors, limit = [], [], np.full(SIZES, np.inf)
    for i, texts in enumerate(own.values()):
        centre = _clusters(np.concatenate([_vectors(counts(p), idf) for p in _text_parts(texts)]), centroids)
        owner += [i] * len(centre)
        vectors += list(centre)
        for part in _text_parts([b for t in texts for b in _beginnings(t) if any(map(str.isalpha, b))]):
            count = counts(part)
            np.minimum.at(limit, _size(count), (_vectors(count, idf) @ centre.T).max(axis=1))
    limit = np.minimum.accumulate(limit[::-1])[::-1]  # a shorter text may lie as far away as a longer one
    limit = np.where(np.isfinite(limit), limit, limit[np.isfinite(limit)][-1:].sum())
    return Centroids(languages, np.array(owner), idf, np.array(vectors, dtype=np.float32), SLACK * limit)


def judged_batches(batches: Iterable[pa.RecordBatch], model: Centroids) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        lang, score, far = [], [], []
        for part in _text_parts(texts):
            count = counts(part)
            spoken = count.any(axis=1) & np.array([bool(t) and any(map(str.isalpha, t[:64])) or bool(t and _WORD_RUN.search(t)) for t in part])
            if len(model.owner):
                cos = _vectors(count, model.idf) @ model.vectors.T
                best = cos.argmax(axis=1)
                top = cos[np.arange(len(part)), best]
                lang += [model.languages[model.owner[b]] if ok else UNKNOWN for b, ok in zip(best, spoken)]
                score += np.where(spoken, np.clip(top, 0, 1), 0.0).tolist()
                far += (~spoken | (top < model.limit[_size(count)])).tolist()
            else:
                lang += [UNKNOWN] * len(part)
                score += [0.0] * len(part)
                far += [True] * len(part)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(far, pa.bool_())],
            names=[*batch.schema.names, "lang_pred", "score", "rejected"],
        )


def identify(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs with lang_pred, score (cosine, 0 to 1) and rejected; columns of these names are replaced.

    A null, empty or letterless text is `und` with score 0 and rejected. Any other text has the language of its
    nearest centroid (ties: the first in order of language), and is rejected if it is too far from it for its size."""
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: languages x centroids x features
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(lambda it: judged_batches(it, shared.value), f"{fields}, lang_pred string, score double, rejected boolean")
