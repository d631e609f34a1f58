"""Mixing to target weights with soft domain membership, in DataFrame functions only.

1. A naive Bayes classifier over hashed words is fitted on labelled rows (at most
   ``sample_rows`` of them, taken by hash order). Its table has ``BUCKETS`` rows, whatever the
   corpus, and is broadcast.
2. Each document gets posteriors p over the domains; the evidence of a long text counts as
   that of ``EVIDENCE`` average words, so membership stays soft.
3. Rates r >= 0, starting at 1, are moved by projected gradient steps on the squared gap
   between expected domain totals sum r * tokens * p and the targets. Steps are added up and
   projected once, r = max(0, 1 - p . u), so a rate follows from one number for each domain, and
   each is scaled by the inverse Gram matrix G of documents with r > 0:

       u <- u + s G^-1 (totals - targets),

   with s = 1 or the first quarter of it that brings the rates nearer (a line search on the
   dual of: totals as near to the targets as can be, rates as near to 1). A look at a step is one
   aggregate over the stored posteriors; ten or so looks are enough, also for targets out of reach.
4. Copies of a document: floor(r + u), u uniform by hash of doc_id; expected copies are r.

Defined results: a document without words has 0 tokens and the prior as posteriors; without
labelled rows of any domain all posteriors are equal; domains whose total cannot be
reached (no document leans to them) leave a gap, which the result states; repeated rows get equal
rates and copies; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import WORD_BREAK, stored, table

BUCKETS = 4096
#: Weight, a token, that holds u where targets are out of reach.
ANCHOR = 1e-9
EVIDENCE = 60.0
SAMPLE_ROWS = 20_000
#: Target shares of the registered query.
TARGETS = {"high": 0.85, "low": 0.10, "toxic": 0.05}


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled rows: toxic, else high or low by quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def _words(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    split = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WORD_BREAK)
    return docs.select(*keep, F.explode(split).alias("word")).where("word <> ''").select(*keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str, text_col: str, sample_rows: int = SAMPLE_ROWS) -> tuple[DataFrame, list[float]]:
    """Log likelihoods (bucket, w_0, w_1, ...) of every bucket and the log priors."""
    picked = labelled.where(F.col("domain").isin(domains)).groupBy("doc_id").agg(F.min("domain").alias("domain"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    counts = _words(own, ["domain"], "text").groupBy("domain", "bucket").agg(F.count(F.lit(1)).alias("n"))
    hits = [F.sum(F.when(F.col("domain") == d, F.col("n")).otherwise(0)).alias(f"n_{i}") for i, d in enumerate(domains)]
    rows = {r["bucket"]: [r[f"n_{i}"] for i in range(len(domains))] for r in counts.groupBy("bucket").agg(*hits).collect()}
    seen = {r["domain"]: r["n"] for r in picked.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    grid = np.array([rows.get(b, [0] * len(domains)) for b in range(BUCKETS)], float) + 0.5
    weights = np.log(grid / grid.sum(0))
    prior = np.array([seen.get(d, 0) + 1.0 for d in domains])
    weights -= weights.mean(1, keepdims=True)
    listed = docs.sparkSession.createDataFrame([(b, *map(float, w)) for b, w in enumerate(weights)], "bucket int, " + ", ".join(f"w_{i} double" for i in range(len(domains))))
    return listed, [float(x) for x in np.log(prior / prior.sum())]


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, tokens, p_0, p_1, ...) by document id; tokens counts words."""
    weights, prior = fit_domains(docs, labelled, domains, id_col, text_col, sample_rows)
    key = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"), F.col(text_col).alias("text"))
    sums = [F.sum(f"w_{i}").alias(f"s_{i}") for i in range(len(domains))]
    scored = _words(key, ["key"], "text").join(F.broadcast(weights), "bucket").groupBy("key").agg(F.count(F.lit(1)).alias("tokens"), *sums)
    # Documents without words join with nothing above; their ids alone are dealt again.
    bare = key.where(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select("key").distinct()
    empty = [F.lit(0).cast("long").alias("tokens"), *(F.lit(0.0).alias(f"s_{i}") for i in range(len(domains)))]
    every = scored.unionByName(bare.select("key", *empty)).groupBy("key").agg(F.sum("tokens").alias("tokens"), *(F.sum(f"s_{i}").alias(f"s_{i}") for i in range(len(domains))))
    weight = F.least(F.lit(EVIDENCE), F.col("tokens")) / F.greatest(F.col("tokens"), F.lit(1))
    logit = [F.lit(prior[i]) + F.col(f"s_{i}") * weight for i in range(len(domains))]
    top = F.greatest(*logit) if len(logit) > 1 else logit[0]
    every = every.select("key", "tokens", *(F.exp(x - top).alias(f"e_{i}") for i, x in enumerate(logit)))
    total = sum((F.col(f"e_{i}") for i in range(1, len(domains))), F.col("e_0"))
    return every.select("key", "tokens", *((F.col(f"e_{i}") / total).alias(f"p_{i}") for i in range(len(domains))))


NO_ID = -(1 << 63)


def _rate(u: Sequence[float]):
    """The rate of a document after steps that sum to u."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{i}") * float(x) for i, x in enumerate(u)), F.lit(0.0)))


class Rates(NamedTuple):
    """The sum u of the steps, the share of all tokens by which a domain's total misses its target at most, and whether that is as little as can be."""

    u: list[float]
    gap: float
    converged: bool


def fit_rates(members: DataFrame, shares: Sequence[float], budget: float | None = None, most_looks: int = 60, close: float = 1e-6) -> Rates:
    """Rates that match ``shares`` of ``budget`` tokens (default: all tokens there are), or miss them by the least squares.

    A few sums, as many as domains squared, reach the driver at each look.
    """
    k = len(shares)

    def look(u):
        at = members.select("tokens", *(f"p_{i}" for i in range(k)), _rate(u).alias("r"))
        sums = [F.sum(F.col("r") * F.col("tokens") * F.col(f"p_{i}")) for i in range(k)]
        gram = [F.sum(F.when(F.col("r") > 0, F.col("tokens") * F.col(f"p_{i}") * F.col(f"p_{j}")).otherwise(0.0)) for i in range(k) for j in range(k)]
        row = at.agg(F.sum("tokens"), F.sum(F.col("tokens") * F.col("r") * F.col("r")), *sums, *gram).first()
        return [np.array(x if x is not None else 0.0, float) for x in (row[0], row[1], row[2 : 2 + k], row[2 + k :])]

    u = np.zeros(k)
    total, energy, sums, gram = look(u)
    if not total:
        return Rates([0.0] * k, 0.0, True)
    goal, anchor, looks = np.array(shares) * (budget or total), ANCHOR * total, 1
    value = lambda u, energy: float(energy) / 2 + goal @ u + anchor / 2 * u @ u
    done = lambda ok: Rates([float(x) for x in u], float(np.abs(sums - goal).max() / total), ok)
    while True:
        gap = sums - goal
        downhill = gap - anchor * u
        if np.abs(gap).max() <= close * total or np.abs(downhill).max() <= 0.1 * close * total:
            return done(True)
        step = np.linalg.solve(gram.reshape(k, k) + anchor * np.eye(k), downhill)
        now, size = value(u, energy), 1.0
        while True:
            if looks >= most_looks:
                return done(False)
            _, energy_, sums_, gram_ = look(u + size * step)
            looks += 1
            if value(u + size * step, energy_) <= now - 1e-4 * size * (downhill @ step) + 1e-12 * abs(now):
                break
            size /= 4
        u, energy, sums, gram = u + size * step, energy_, sums_, gram_


def mix_documents(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, growth: float = 1.0, id_col: str = "doc_id", text_col: str = "text", relative: bool = False) -> DataFrame:
    """(id, n_tokens, p_<domain> ..., rate, copies, gap, converged) by document id.

    gap: the share of all tokens by which some domain's expected total misses its target, at
    most; converged: whether it is as small as it can be, or the steps ran out, which also warns.
    growth: expected tokens after mixing as a multiple of those before it; relative: targets
    are not shares of these but multiples of what each domain has before.
    """
    domains = sorted(targets)
    members = stored(posteriors(docs, domain_of(labels), domains, id_col, text_col), "members")
    now = members.agg(F.sum("tokens"), *(F.sum(F.col("tokens") * F.col(f"p_{i}")) for i in range(len(domains)))).first()
    total = float(now[0] or 0) * growth
    shares = [targets[d] * (growth * (now[1 + i] or 0.0) / max(total, 1.0) if relative else 1.0) for i, d in enumerate(domains)]
    u, gap, converged = fit_rates(members, shares, total)
    if not converged:
        warnings.warn(f"mixing: the rates miss the targets by {gap:.2g} of all tokens after the last look", stacklevel=2)
    found = members.select("key", "tokens", *(F.col(f"p_{i}").alias(f"p_{d}") for i, d in enumerate(domains)), _rate(u).alias("rate"))
    unit = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 32)) / F.lit(float(1 << 32))
    return found.select(F.nullif("key", F.lit(NO_ID)).alias(id_col), F.col("tokens").alias("n_tokens"), *(f"p_{d}" for d in domains), "rate", F.floor(F.col("rate") + unit).alias("copies"), F.lit(gap).alias("gap"), F.lit(converged).alias("converged"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships, rates and copies of every document."""
    return mix_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
