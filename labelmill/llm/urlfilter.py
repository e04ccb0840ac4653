"""URL filter: rules first, then naive Bayes over the words that hosts and paths are made of.

Concatenated names (`cheappills`) are split by unigram Viterbi: the split of highest probability under word counts of
the pages' own text. Multinomial naive Bayes then scores the words of host and path. Its labels are the urls that a
rule decides; the urls without a rule get the verdict of the higher score.

Both models are tables of all their words and never gathered in one place: distinct tokens of urls meet the counts of
their own substrings by joins, and the words of a token its weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, land

#: Rules of the filter: verdict, host and path as one text.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Letters of the pieces that a token meets word counts by; longer words meet it by their first letters.
PIECE = 20
_TOKEN = re.compile(r"[^\W\d_]+|\d+")


def host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host_: Column, path_: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits the host or a parent domain of it and starts the path, and its verdict; else null."""
    name = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, _, start = text.partition("/")
        fits = ((host_ == domain) | host_.endswith("." + domain)) & path_.startswith("/" + start)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """word, n: counts of all words of all texts, tags left out."""
    plain = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"<[^>]*>", " "))
    words = texts.select(F.explode(F.split(plain, r"[^\p{L}]+")).alias("word")).filter("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class Unigrams:
    cost: dict[str, float]
    total: int

    @staticmethod
    def of(counts: dict[str, int]) -> Unigrams:
        total = sum(counts.values()) or 1
        return Unigrams({w: math.log(total / n) for w, n in counts.items()}, total)

    def split(self, token: str) -> list[str]:
        """The cheapest split into words; an unknown run of letters costs ten times more with each letter.

        A word or run may have any length. Of the runs that end at a letter the cheapest begins where the cost so far
        less the cost of the letters so far is least, so one running minimum stands for all of them."""
        base, ten = math.log(self.total) - math.log(10), math.log(10)
        longest = max(map(len, self.cost), default=0)
        best, back = [0.0] + [math.inf] * len(token), [0] * (len(token) + 1)
        start, low = 0, 0.0
        for i in range(1, len(token) + 1):
            best[i], back[i] = best[start] + base + ten * (i - start), start
            for j in range(max(0, i - longest), i):
                c = self.cost.get(token[j:i])
                if c is not None and (best[j] + c, j) < (best[i], back[i]):
                    best[i], back[i] = best[j] + c, j
            if best[i] - ten * i < low:
                start, low = i, best[i] - ten * i
        out, i = [], len(token)
        while i:
            out.append(token[back[i] : i])
            i = back[i]
        return out[::-1]


def parts(host_: str, path_: str) -> list[tuple[str, str]]:
    """The mark (h: or p:) and the token of each run of letters or digits; digits of any number become one token."""
    return [(mark, "0" if token[0].isdigit() else token) for mark, text in (("h:", host_), ("p:", path_)) for token in _TOKEN.findall(text.lower())]


def _id(*texts: Column) -> Column:
    """The MD5 of texts, by which urls and tokens go where they meet many rows, for they may be long."""
    return F.unhex(F.md5(F.concat_ws("\0", *texts).cast("binary")))


def part_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, pos, mark, token) of the parts of each (uid, host, path)."""
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            some = batch.slice(a, 4096)
            found = [parts(h, p) for h, p in zip(some.column("host").to_pylist(), some.column("path").to_pylist())]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [some.column("uid").take(at), pa.array([k for f in found for k in range(len(f))], pa.int32()),
                 pa.array([m for f in found for m, _ in f], pa.string()), pa.array([t for f in found for _, t in f], pa.string())],
                names=["uid", "pos", "mark", "token"],
            )


def piece_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, word): the pieces of each (tid, token) of up to PIECE letters, some thousand places at a time, each once in these."""
    for batch in batches:
        for tid, token in zip(batch.column("tid").to_pylist(), batch.column("token").to_pylist()):
            for a in range(0, len(token), 4096):
                some = sorted({token[j:i] for j in range(a, min(len(token), a + 4096)) for i in range(j + 1, min(len(token), j + PIECE) + 1)})
                yield pa.RecordBatch.from_pydict({"tid": pa.array([tid] * len(some), pa.binary()), "word": pa.array(some, pa.string())})


def split_batches(batches: Iterable[pa.RecordBatch], total: int) -> Iterator[pa.RecordBatch]:
    """(tid, words) of tokens with the counts of their known pieces."""
    for batch in batches:
        words = []
        for token, known in zip(batch.column("token").to_pylist(), batch.column("known").to_pylist()):
            cost = {k["word"]: math.log(total / k["n"]) for k in known}
            words.append([token] if token == "0" else Unigrams(cost, total).split(token))
        yield pa.RecordBatch.from_arrays([batch.column("tid"), pa.array(words, pa.list_(pa.string()))], names=["tid", "words"])


def splits(tokens: DataFrame, counts: DataFrame) -> DataFrame:
    """(tid, words) of distinct tokens (tid, token) by the unigram costs of all counted words."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    pieces = land(tokens.mapInArrow(piece_batches, "tid binary, word string"))
    met = keyed_join(pieces, counts, ["word"]).select("tid", "word", "n")
    # a longer word may lie in a token that has its first PIECE letters; the split finds out
    long = counts.filter(F.length("word") > PIECE).groupBy(F.left("word", F.lit(PIECE)).alias("word")).agg(F.collect_list(F.struct("word", "n")).alias("more"))
    whole = keyed_join(pieces.filter(F.length("word") == PIECE), long, ["word"]).select("tid", F.explode("more").alias("m")).select("tid", "m.word", "m.n")
    known = met.unionByName(whole).groupBy("tid").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    ready = tokens.join(known, "tid", "left").select("tid", "token", F.coalesce("known", F.expr("cast(array() as array<struct<word: string, n: bigint>>)")).alias("known"))
    return ready.mapInArrow(lambda it: split_batches(it, total), "tid binary, words array<string>")


def weights(words: DataFrame) -> DataFrame:
    """(word, weight): log odds of block of every word of (word, verdict, n), with add-one smoothing."""
    per = land(words.groupBy("word").agg(*(F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow"))))
    all_ = per.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    block, allow = float(all_[1] + all_[0]), float(all_[2] + all_[0])
    return per.select("word", (F.log((F.col("block") + 1) / F.lit(block)) - F.log((F.col("allow") + 1) / F.lit(allow))).alias("weight"))


def prior(labelled: DataFrame) -> float:
    rows = {r["verdict"]: r["n"] for r in labelled.groupBy("verdict").agg(F.sum("n").alias("n")).collect()}
    return math.log((rows.get("block", 0) + 1) / (rows.get("allow", 0) + 1))


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", text: str = "html", rules=RULES) -> DataFrame:
    """key, host, path, rule, verdict, words and score (log odds of block) for every row.

    The longest fitting rule decides; without one, block where the score is above 0. A null url or one without `://`
    has an empty host and path and falls to the classifier's prior. Repeated rows are judged alike. An empty table
    gives no rows; other columns are not read."""
    named = pages.select(F.col(key), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    name, verdict = rule(F.col("host"), F.col("path"), rules)
    judged = named.withColumns({"rule": name, "verdict": verdict})
    one = ["host", "path"]
    urls = land(judged.groupBy(*one, "verdict").agg(F.count("*").alias("n")).withColumn("uid", _id(F.col("host"), F.col("path"))))  # a verdict follows from host and path
    found = land(urls.select("uid", *one).mapInArrow(part_batches, "uid binary, pos int, mark string, token string").withColumn("tid", _id(F.col("token"))))
    tokens = land(found.groupBy("tid").agg(F.max("token").alias("token")))
    split = land(splits(tokens, land(word_counts(pages, text))))
    found = found.drop("token")

    labelled = urls.filter("verdict is not null")
    times = found.join(labelled.select("uid", "verdict", "n"), "uid").groupBy("mark", "tid", "verdict").agg(F.sum("n").alias("n"))
    words = times.join(split, "tid").select(F.explode("words").alias("w"), "mark", "verdict", "n").select(F.concat("mark", "w").alias("word"), "verdict", "n")
    weight = weights(words)
    start = prior(labelled)

    # what each marked token adds: its words in order, and their weights
    marked = found.select("mark", "tid").distinct().join(split, "tid")
    each = marked.select("mark", "tid", F.posexplode("words").alias("k", "w")).withColumn("word", F.concat("mark", "w"))
    parted = land(each.join(weight, "word", "left").groupBy("mark", "tid").agg(F.sort_array(F.collect_list(F.struct("k", "w", F.coalesce("weight", F.lit(0.0)).alias("x")))).alias("ws")))
    scored = (
        keyed_join(found, parted, ["mark", "tid"]).groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("pos", "ws"))).alias("all"))
        .withColumn("all", F.flatten(F.col("all.ws")))
        .select("uid", F.col("all.w").alias("words"), (F.aggregate(F.col("all.x"), F.lit(0.0), lambda a, x: a + x) + F.lit(start)).alias("score"))
    )
    met = judged.withColumn("uid", _id(F.col("host"), F.col("path"))).join(scored, "uid", "left")
    out = met.withColumns({"words": F.coalesce("words", F.expr("cast(array() as array<string>)")), "score": F.coalesce("score", F.lit(start))})
    return out.select(*judged.columns, "words", "score").withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") > 0, "block").otherwise("allow")))
