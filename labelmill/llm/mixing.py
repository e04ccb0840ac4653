"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents collapse to cells (one for each source, language and topic that occurs together); raking works on the cells
alone, which are few whatever the corpus holds. No cell can give more than its tokens: cells that are full are held and
the others raked again, so that the expected sample meets budget and target shares. The documents are read twice: for
the cell totals and to be sampled.
"""

from __future__ import annotations

import logging

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, land, unused

DIMENSIONS = ("source", "lang", "topic")
#: Topics by the first pattern that a text is LIKE.
TOPICS = (("table", "% | %"), ("licence", "%icense%"), ("contact", "%@%"), ("link", "%http%"))
#: Up to so many cells are fitted in the driver (some 12 MB); more stay distributed. Both ways give the same weights.
LOCAL_CELLS = 200_000
#: Rounds at most, and the residual of a marginal (a share of the budget) that ends them.
ROUNDS, TOLERANCE = 200, 1e-12
#: A marginal further than this share of the budget from its target is logged.
MISSED = 1e-6


def topic(text: Column) -> Column:
    out = F.when(text.isNull() | (text == ""), "empty")
    for name, pattern in TOPICS:
        out = out.when(text.like(pattern), name)
    return out.otherwise("prose")


def tokens(text: Column) -> Column:
    """Blank-separated words, at least one, of a text; a null text has one."""
    return F.coalesce(F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))), F.lit(0)).cast("bigint") + 1


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest, the same on every run and engine."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed))), 1, 8), 16, 10).cast("double") / 4294967296.0


def _factors(full: np.ndarray, w: np.ndarray, at: np.ndarray, target: np.ndarray) -> np.ndarray:
    """For each group the factor f with sum(min(full, f * w)) = target, or the least that fills the group."""
    use = w > 0
    full, ratio = np.where(use, full, 0.0), np.divide(full, w, out=np.zeros_like(w), where=use)
    order = np.lexsort((ratio, at))
    g, t, v, r = at[order], full[order], w[order], ratio[order]
    n = len(target)
    before = np.append(0, np.cumsum(np.bincount(g, minlength=n)))[:-1]
    sums, rest = np.append(0, np.cumsum(t)), np.append(0, np.cumsum(v))
    reached = sums[1:] - sums[before[g]] + r * np.maximum(0, np.bincount(g, v, n)[g] - (rest[1:] - rest[before[g]]))
    low = reached <= target[g]
    held, free, most = np.bincount(g, t * low, n), np.bincount(g, v * ~low, n), np.zeros(n)
    np.maximum.at(most, g, r)
    return np.divide(np.maximum(0, target - held), free, out=most, where=free > 0)


def _factor_table(df: DataFrame, d: list[str], target: Column) -> DataFrame:
    """The factors of `_factors` by d, for df with `full`, `w` and the target of its group."""
    some = df.filter("w > 0").withColumns({"_r": F.col("full") / F.col("w"), "_t": target})
    own, upto = Window.partitionBy(*d), Window.partitionBy(*d).orderBy("_r").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.sum("full").over(upto) + F.col("_r") * F.greatest(F.lit(0.0), F.sum("w").over(own) - F.sum("w").over(upto))
    low = F.col("_low")
    return (
        some.withColumn("_low", reached <= F.col("_t")).groupBy(*d)
        .agg(F.sum(F.when(low, F.col("full")).otherwise(0.0)).alias("held"), F.sum(F.when(low, 0.0).otherwise(F.col("w"))).alias("free"), F.max("_r").alias("most"), F.first("_t").alias("_t"))
        .select(*d, F.when(F.col("free") > 0, F.greatest(F.lit(0.0), F.col("_t") - F.col("held")) / F.col("free")).otherwise(F.col("most")).alias("factor"))
    )


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = ROUNDS, local: int = LOCAL_CELLS) -> DataFrame:
    """cells (dimensions, tokens, w) with w the expected tokens, in all `budget` of the tokens, at the target shares.

    No cell gives more than its tokens: full cells are held and the others raked again, until every marginal is met
    within TOLERANCE or `rounds` are over. A value whose whole tokens are below its share is taken whole, and the rest
    of its share falls to the other values of its dimension in proportion. What is still missed is logged by value."""
    cells = cells.withColumns({"w": F.col("tokens").cast("double"), "full": F.col("tokens").cast("double")})
    if cells.limit(local + 1).count() > local:
        return _raked_table(cells, targets, budget, rounds)
    rows = [r.asDict() for r in cells.collect()]
    full, steps = np.array([r["full"] for r in rows]), []
    want, w = budget * full.sum(), full.copy()
    for d, wanted in targets.items():
        share = {r[d]: r["share"] for r in wanted.collect()}
        values = sorted({r[d] for r in rows})
        index = {v: i for i, v in enumerate(values)}
        at, p = np.array([index[r[d]] for r in rows], dtype=np.int64), np.array([share.get(v, 0.0) for v in values])
        have = np.bincount(at, full, len(values))
        steps.append((d, values, at, np.minimum(have, p * _factors(have, p, np.zeros(len(p), dtype=np.int64), np.array([want]))), p))
    missed: list[tuple[str, str, float, float]] = []
    for _ in range(rounds if rows else 0):
        for _, _, at, target, _ in steps:
            w = w * _factors(full, w, at, target)[at]
        got = [np.bincount(at, np.minimum(full, w), len(values)) for _, values, at, _, _ in steps]
        if max(np.abs(x - s[3]).max() for x, s in zip(got, steps)) <= TOLERANCE * want:
            break
    if rows:
        missed = [(d, v, float(s), float(x / want)) for x, (d, values, _, _, p) in zip(got, steps) for v, s, x in zip(values, p, x) if abs(x / want - s) > MISSED]
    _log(missed)
    return cells.sparkSession.createDataFrame([tuple((r | {"w": float(min(f, x))})[c] for c in cells.columns) for r, f, x in zip(rows, full, w)], cells.schema).drop("full")


def _log(missed: list[tuple[str, str, float, float]]) -> None:
    for d, v, s, x in sorted(missed, key=lambda m: -abs(m[2] - m[3])):
        logging.getLogger(__name__).warning("mixing: %s %s has share %.6f of the budget, target %.6f", d, v, x, s)


def _raked_table(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int) -> DataFrame:
    want = budget * cells.agg(F.sum("full")).first()[0]
    aims = {}
    for d, wanted in targets.items():
        have = cells.groupBy(d).agg(F.sum("full").alias("full")).join(wanted, d, "left").select(d, "full", F.coalesce("share", F.lit(0.0)).alias("w"))
        f = _factor_table(have.withColumn("_all", F.lit(1)), ["_all"], F.lit(want)).first()
        aims[d] = land(have.select(d, F.col("w").alias("share"), F.least("full", F.col("w") * F.lit(f["factor"] if f else 0.0)).alias("aim")))
    now = cells
    gap = lambda d, to: now.groupBy(d).agg(F.sum(F.least("full", "w")).alias("x")).join(aims[d], d).withColumn("gap", F.abs(F.col("x") - to))
    for _ in range(rounds):
        for d, aim in aims.items():
            factor = _factor_table(now.join(aim.select(d, "aim"), d), [d], F.col("aim"))
            after = land(now.join(factor, d, "left").withColumn("w", F.coalesce(F.col("w") * F.col("factor"), F.lit(0.0))).select(*cells.columns))
            discard(now)
            now = after
        if max(gap(d, F.col("aim")).agg(F.max("gap")).first()[0] for d in aims) <= TOLERANCE * want:
            break
    for d in aims:  # the 20 largest of each dimension are logged
        left = gap(d, F.col("share") * want).filter(F.col("gap") > MISSED * want).orderBy(F.col("gap").desc()).limit(20).collect()
        _log([(d, r[d], r["share"], r["x"] / want) for r in left])
    return now.withColumn("w", F.least("full", "w")).drop("full")


def smoothed_targets(cells: DataFrame, powers: dict[str, float]) -> dict[str, DataFrame]:
    """Shares in proportion to (token share) ** power for each dimension."""
    out = {}
    for d, power in powers.items():
        own = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("p"))
        out[d] = own.crossJoin(F.broadcast(own.agg(F.sum("p").alias("all")))).select(d, (F.col("p") / F.col("all")).alias("share"))
    return out


POWERS = {"source": 0.5, "lang": 0.5, "topic": 0.7}


def mixed(docs: DataFrame, powers: dict[str, float] = POWERS, budget: float = 0.5, rounds: int = ROUNDS, seed: str = ":mix", targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """docs with `topic`, `n_words`, `chance` and `sampled`: kept with probability `chance`, by a hash of doc_id.

    The expected tokens of the sample are `budget` of all tokens, with the target share of every source, language and
    topic (`targets`: for each dimension its values and shares; else the smoothed shares of the corpus) wherever the
    documents hold so many tokens; see `rake` for the rest. Null sources or languages form a value of their own (`?`).
    Null and empty texts count one token. Rows that repeat a doc_id are sampled alike. An empty table gives no rows.
    Columns of docs with the four names are replaced; all others stay as they are, whatever their names."""
    docs = docs.drop("topic", "n_words", "chance", "sampled")
    source, lang = unused(docs, "source_"), unused(docs, "lang_")
    keyed = docs.withColumns({source: F.coalesce("source", F.lit("?")), lang: F.coalesce("lang", F.lit("?")), "topic": topic(F.col("text")), "n_words": tokens(F.col("text"))})
    cells = land(keyed.groupBy(F.col(source).alias("source"), F.col(lang).alias("lang"), "topic").agg(F.sum("n_words").alias("tokens")))
    fitted = rake(cells, targets or smoothed_targets(cells, powers), budget, rounds)
    chances = fitted.select(F.col("source").alias(source), F.col("lang").alias(lang), "topic", (F.col("w") / F.col("tokens")).alias("chance"))
    if cells.limit(LOCAL_CELLS + 1).count() <= LOCAL_CELLS:
        chances = F.broadcast(chances)  # counted: texts then need no shuffle
    return (
        keyed.join(chances, [source, lang, "topic"], "left")
        .withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("chance"))
        .select(*docs.columns, "topic", "n_words", "chance", "sampled")
    )


def mixed_sql(powers: dict[str, float] = POWERS, budget: float = 0.5, rounds: int = ROUNDS, seed: str = ":mix") -> str:
    """The same rows in SQL: the rounds are a recursion over the cells."""
    case = "case when text is null or text = '' then 'empty' " + " ".join(f"when text like '{p}' then '{n}'" for n, p in TOPICS) + " else 'prose' end"
    ctes = [
        f"d as (select doc_id, coalesce(source,'?') as source, coalesce(lang,'?') as lang, {case} as topic, "
        "coalesce(length(text)-length(replace(text,' ','')),0)+1 as n_words from documents)",
        "c as materialized (select source, lang, topic, sum(n_words) as tokens, cast(sum(n_words) as double) as f from d group by all)",
        f"wanted as (select {budget}*sum(f) as want from c)",
    ]
    for k, power in powers.items():  # shares, held to what a value has
        ctes += [
            f"p_{k} as (select {k}, sum(f) as have, pow(sum(f),{power}) as p from c group by all)",
            f"t_{k} as (select *, p/(select sum(p) from p_{k}) as share from p_{k})",
            f"l_{k} as (select *, sum(have) over (order by have/share) + have/share*greatest(0,sum(share) over ()-sum(share) over (order by have/share))<=want as low from t_{k}, wanted)",
            f"a_{k} as materialized (select {k}, least(have, share*case when sum(case when low then 0 else share end) over ()>0 "
            f"then greatest(0,want-sum(case when low then have else 0 end) over ())/sum(case when low then 0 else share end) over () else max(have/share) over () end) as aim_{k} from l_{k})",
        ]
    state = "it, source, lang, topic, f, " + ", ".join(f"aim_{k}" for k in powers)
    step = "r"
    for k in powers:
        step = (
            f"(select {state}, w*case when free>0 then greatest(0,aim_{k}-held)/free else most end as w from (select *, sum(case when low then f else 0 end) over g as held, "
            f"sum(case when low then 0 else w end) over g as free, max(f/w) over g as most from (select *, sum(f) over u + f/w*greatest(0,sum(w) over g-sum(w) over u)<=aim_{k} as low "
            f"from {step} q_{k} where w>0 window g as (partition by {k}), u as (partition by {k} order by f/w)) s_{k} window g as (partition by {k})) v_{k})"
        )
    ctes += [
        "r as (select 0 as it, source, lang, topic, f, " + ", ".join(f"aim_{k}" for k in powers) + ", f as w from c " + " ".join(f"join a_{k} using ({k})" for k in powers)
        + f" union all select it+1, source, lang, topic, f, {', '.join(f'aim_{k}' for k in powers)}, w from {step.replace('from r q_', f'from (select * from r where it<{rounds}) q_')} z)",
        f"e as (select source, lang, topic, least(f,w)/f as chance from r where it={rounds})",
    ]
    return (
        "with recursive " + ", ".join(ctes) + " select d.doc_id, d.topic, cast(d.n_words as bigint) as n_words, round(e.chance, 6) as chance, "
        f"cast('0x'||substr(md5(concat(cast(d.doc_id as varchar),'{seed}')),1,8) as bigint)/4294967296.0 < e.chance as sampled "
        "from d join e using (source, lang, topic)"
    )
