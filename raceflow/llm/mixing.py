"""Mixing to target weights by soft membership (DataFrame operations only).

A multinomial classifier, fitted on the labelled rows, predicts each document's
posterior over domains: ``toxic`` (label toxic = 1), ``plain`` (quality 0) and ``good``
(quality 1). Every document has a rate of at least 0; the rates are fitted so that the
expected tokens of each domain, the sum of rate * tokens * posterior, equal the target weight
times the budget. The fit is least squares on the gaps, by projected gradient from rate 1
in a variable metric: r <- max(0, r - posterior . M^-1 gap), where M is the token-weighted
second moment of the posteriors of documents with a rate above 0; a step that does not
lower the gaps is halved. An iteration is one aggregate over the stored posteriors that
sends gaps and M (a few numbers) to the driver; a document's rate is the fold of the
steps, so no state is shuffled.

Lexicon and classifier are fitted on a bounded sample of labelled rows (``most_rows``,
by a hash of the id); posteriors and rates cover all rows. Labels repeated for a
document count once (largest toxic, smallest quality). Null texts count as empty; texts
without words have 0 tokens, a posterior like any other, and rate 1 (no gradient). Without labels of two
domains every posterior is the share of labels (1 for ``good`` without labels). An empty
table gives an empty result. Repeated rows are rated each.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.session import cut_lineage, release

DOMAINS = ("good", "plain", "toxic")
TARGETS = (0.85, 0.11, 0.04)
SIGNS = "|#&%$*!?.,"
BEGIN = (5, 7)
LEAST_ROWS = 4
MOST_ENTRIES = 1_000
BUDGET = 0.9  # of all tokens, so that good documents need no repeats
STEPS = 20
GAP = 1e-4
REACHED = 2e-3  # gap, as a share of the budget, at which a draw's targets count as met
SHRINK, TRIES = 0.93, 40


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[ \n]"), "")


def _beginnings(distinct: Column) -> Column:
    """Distinct first characters of the distinct words, at each length."""
    return F.array_union(*[F.transform(distinct, lambda w, n=n: F.substring(w, 1, n)) for n in BEGIN])


def _worded(rows: DataFrame, *keep: str) -> DataFrame:
    words = rows.select(*keep, "text", _words(F.col("text")).alias("words"))
    return words.select("*", F.array_distinct("words").alias("kinds"))


def lexicon(train: DataFrame) -> list[str]:
    """Word beginnings that mark toxic rows; at most ``MOST_ENTRIES``."""
    sizes = train.agg(F.count_if(F.col("domain") == 2), F.count_if(F.col("domain") != 2)).first()
    if not sizes[0] or not sizes[1]:
        return []
    seen = train.select("domain", F.explode(_beginnings(F.col("kinds"))).alias("w")).groupBy("w").agg(
        F.count_if(F.col("domain") == 2).alias("bad"), F.count_if(F.col("domain") != 2).alias("rest"))
    odds = F.log((F.col("bad") + 0.5) / (sizes[0] + 1)) - F.log((F.col("rest") + 0.5) / (sizes[1] + 1))
    top = seen.filter(F.col("bad") >= LEAST_ROWS).withColumn("odds", odds).filter("odds >= 2.5")
    return [r["w"] for r in top.orderBy(F.desc("odds"), F.desc("bad"), "w").limit(MOST_ENTRIES).select("w").collect()]


def _features(text: Column, words: Column, kinds: Column, marks: list[str]) -> dict[str, Column]:
    """Dense features by name from a text, its words and its distinct words; all native and linear in the text."""
    body = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(body), F.lit(1))
    many = F.greatest(F.size(words), F.lit(1))
    made = {f"sign{i}": (F.length(body) - F.length(F.replace(body, F.lit(c), F.lit("")))) / chars * 20
            for i, c in enumerate(SIGNS)}
    made["distinct"] = F.size(kinds) / many
    made["size"] = F.log1p(many)
    made["breaks"] = F.log1p((F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit("")))) / many * 10)
    hits = F.size(F.array_intersect(_beginnings(kinds), F.lit(marks).cast("array<string>"))) if marks else F.lit(0)
    made["hits"] = F.log1p(hits)
    made["any_hit"] = (hits > 0).cast("double")
    made["hit_rate"] = F.least(hits / many * 20, F.lit(3.0))
    return {k: c.cast("double") for k, c in made.items()}


def posteriors(docs: DataFrame, labels: DataFrame, most_rows: int = 12_000) -> DataFrame:
    """doc_id, tokens and p (array over DOMAINS) for every row; stored."""
    known = labels.select("doc_id", "quality", "toxic").dropna().groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    known = known.select("doc_id", domain.alias("domain"))
    total = known.count()
    share = min(1.0, most_rows / max(total, 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1e6).limit(2 * most_rows)
    train = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # bounded by the limit above
    train = cut_lineage(_worded(train, "domain"))
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    counts = {r["domain"]: r["n"] for r in train.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    body = _worded(docs, "doc_id")
    if len(counts) < 2:
        rows = sum(counts.values())
        p = F.array(*[F.lit(counts.get(d, 0) / rows if rows else float(d == 0)) for d in range(len(DOMAINS))])
        return cut_lineage(body.select("doc_id", F.size("words").cast("long").alias("tokens"), p.alias("p")))

    def featured(rows: DataFrame, marks: list[str], *keep) -> DataFrame:
        return rows.select(*keep, *[c.alias(k) for k, c in _features(F.col("text"), F.col("words"), F.col("kinds"), marks).items()])

    # each half is described by the other half's lexicon, as unseen texts will be
    one, two = train.filter(half == 0), train.filter(half == 1)
    rows = featured(one, lexicon(two), "domain").unionByName(featured(two, lexicon(one), "domain"))
    names = rows.columns[1:]
    rows = cut_lineage(rows)
    fitted = LogisticRegression(labelCol="domain", family="multinomial", maxIter=40, regParam=1e-4).fit(
        VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    weights, bias = fitted.coefficientMatrix.toArray().tolist(), fitted.interceptVector.toArray().tolist()

    described = featured(body, lexicon(train), "doc_id", F.size("words").cast("long").alias("tokens"))
    logits = [F.lit(bias[d]) + sum(F.col(n) * w for n, w in zip(names, weights[d])) if d in counts else F.lit(-1e9)
              for d in range(len(bias))]
    logits += [F.lit(-1e9)] * (len(DOMAINS) - len(logits))
    scored = described.select("doc_id", "tokens", *[x.alias(f"l{d}") for d, x in enumerate(logits)])
    top = F.greatest(*[F.col(f"l{d}") for d in range(len(DOMAINS))])
    scored = scored.select("doc_id", "tokens", *[F.exp(F.col(f"l{d}") - top).alias(f"e{d}") for d in range(len(DOMAINS))])
    whole = sum(F.col(f"e{d}") for d in range(len(DOMAINS)))
    return cut_lineage(scored.select("doc_id", "tokens", F.array(
        *[F.col(f"e{d}") / whole for d in range(len(DOMAINS))]).alias("p")))


def _rate(steps: list[list[float]], start: float = 1.0, most: float | None = None) -> Column:
    """max(0, r - p . step), at most ``most``, over all steps from ``start``; rows without tokens stay at 1."""
    if not steps:
        return F.when(F.col("tokens") > 0, F.lit(start)).otherwise(F.lit(1.0))
    table = "array(" + ", ".join("array(" + ", ".join(f"{x!r}D" for x in step) + ")" for step in steps) + ")"
    dot = " + ".join(f"p[{d}] * g[{d}]" for d in range(len(DOMAINS)))
    next_rate = f"greatest(0.0D, r - ({dot}))" if most is None else f"least({most!r}D, greatest(0.0D, r - ({dot})))"
    return F.expr(f"IF(tokens > 0, aggregate({table}, {start!r}D, (r, g) -> {next_rate}), 1.0D)")


def rates(members: DataFrame, targets: tuple[float, ...] = TARGETS, steps: int = STEPS, gap: float = GAP,
          budget: float = BUDGET) -> DataFrame:
    """``members`` (doc_id, tokens, p; stored) with ``rate``. The budget is a share of all tokens."""
    return members.withColumn("rate", _rate(_fitted(members, targets, steps, gap, budget)[0]))


def _fitted(members: DataFrame, targets: tuple[float, ...], steps: int, gap: float, budget: float,
            start: float = 1.0, most: float | None = None) -> tuple[list[list[float]], float]:
    """The steps from ``start``, and the largest gap left (a share of all tokens)."""
    goal = np.array(targets, float) / sum(targets) * budget
    domains = range(len(goal))
    lower = 0.999 if most is None else 0.95  # with a bound, a fit that slows down is left for a smaller budget
    inside = F.col("rate") > 0 if most is None else (F.col("rate") > 0) & (F.col("rate") < most)

    def gather(taken: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rows = members.withColumn("rate", _rate(taken, start, most))
        sums = [F.sum(F.col("rate") * F.col("tokens") * F.get("p", d)) for d in domains]
        sums += [F.sum(F.when(inside, F.col("tokens") * F.get("p", d) * F.get("p", e))) for d in domains for e in domains]
        row = [float(x or 0.0) for x in rows.agg(*[x.alias(f"x{i}") for i, x in enumerate(sums)]).first()]
        return np.array(row[:len(goal)]), np.array(row[len(goal):]).reshape(len(goal), len(goal))

    held, moment = gather([])
    tokens, taken = held.sum() / start, []
    while tokens and len(taken) < steps:
        gaps = held / tokens - goal
        if np.abs(gaps).max() < gap:
            break
        step = np.linalg.lstsq(moment / tokens, gaps, rcond=1e-9)[0]
        for _ in range(8 if most is None else 4):
            next_held, next_moment = gather([*taken, step.tolist()])
            if np.linalg.norm(next_held / tokens - goal) < np.linalg.norm(gaps) * lower:
                break
            step = step / 2
        else:
            break  # no step lowers the gaps: they cannot be closed with these documents
        taken.append(step.tolist())
        held, moment = next_held, next_moment
    return taken, float(np.abs(held / tokens - goal).max()) if tokens else 0.0


def chances(members: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float = 1.0, gap: float = REACHED) -> DataFrame:
    """``members`` (stored) with ``rate`` from 0 to 1, so that each document is taken once at most.

    The budget is the largest share of all tokens, up to ``budget``, at which the targets are met within
    ``gap``: no domain can give more than it has (the scarcest sets the bound), and since documents belong
    to several domains, the bound is lowered by ``SHRINK`` until the rates close the gaps.
    """
    tokens = [F.sum(F.col("tokens") * F.get("p", d)) for d in range(len(DOMAINS))]
    supply = np.array([float(x or 0.0) for x in members.agg(*[t.alias(f"x{i}") for i, t in enumerate(tokens)]).first()])
    goal = np.array(targets, float) / sum(targets)
    wanted = goal > 0
    share = float(min([budget, *(supply[wanted] / max(supply.sum(), 1e-300) / goal[wanted])]))
    if share <= 0:  # no tokens, or a wanted domain that no document has: there is no mixture to aim at
        return members.withColumn("rate", F.lit(1.0))
    for _ in range(TRIES):
        taken, left = _fitted(members, targets, STEPS, gap * share / 4, share, min(share, 1.0), 1.0)
        release(members.sparkSession)
        if left <= gap * share:
            break
        share *= SHRINK
    return members.withColumn("rate", _rate(taken, min(share if left <= gap * share else share / SHRINK, 1.0), 1.0))


def mix(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """doc_id, tokens, p_<domain> and rate for every row of ``docs``."""
    rated = rates(posteriors(docs, labels), targets)
    return rated.select("doc_id", "tokens", *[F.get(F.col("p"), d).alias(f"p_{name}") for d, name in enumerate(DOMAINS)], "rate")


def drawn(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, budget: float = 1.0) -> DataFrame:
    """Rows of ``docs`` (unchanged), drawn without repeats so that their tokens meet the targets by posterior.

    Every document has its rate (``chances``) as its chance, whatever its domain. The draw is systematic:
    per likeliest domain, documents stand in a row from the longest to the shortest, and one is taken wherever
    the running sum of rates passes a whole number. So the tokens taken differ from the rates' by less than those of
    one document of each domain. Rows of one doc_id share their largest rate and go or stay together; null is an id too.
    """
    rated = chances(posteriors(docs, labels), targets, budget)
    best = F.array_position("p", F.array_max("p"))
    ids = cut_lineage(rated.groupBy("doc_id").agg(F.max("rate").alias("rate"), F.sum("tokens").alias("tokens"), F.min(best).alias("domain")))
    ids = ids.withColumn("order", F.xxhash64("doc_id", F.lit(9)))
    row = skew.history(ids, ["domain"], [("tokens", False), "order", "doc_id"], totals={"before": F.col("rate")}, hot=skew.EVERYTHING)
    taken = F.floor(F.col("before") + F.col("rate") + 0.5) > F.floor(F.col("before") + 0.5)
    gone = row.filter(~((F.col("rate") >= 1) | taken)).select(F.col("doc_id").alias("_id"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_id"]), "left_anti")
