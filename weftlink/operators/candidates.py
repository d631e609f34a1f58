"""Candidate pairs: keyed join, cap on frequent keys, score, best ones per anchor.

The key string holds the country, so one equi-join serves all countries and no loop over
them is needed. Frequent keys are cut before the join, which bounds both its fan-out and
its skew: the rank that decides the cut is limited per key already in the map tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftlink.functions.keys import KeyRules, blocking_keys
from weftlink.functions.similarity import blocking_score, similarities
from weftlink.functions.text import filled
from weftlink.plans.settings import DEFAULT, Settings

FIELDS = ("name_norm", "clean_address", "city", "postal_code", "country_norm")
PAIR = ("s1_entity_id", "target_entity_id", "source_id", "blocking_score") + tuple(f"{side}_{f}" for side in ("s1", "target") for f in ("name", "address", "city", "postal", "country"))

#: Structs of the similarities of names and addresses.
MEASURES = ("_n", "_a")


def target_space(*sources: tuple[DataFrame, int]) -> DataFrame:
    """The targets of several sources under one roof; ``pos`` orders the rows of a source (default: the id)."""
    parts = [df.select("entity_id", F.lit(n).alias("source_id"), *FIELDS, (F.col("pos") if "pos" in df.columns else F.col("entity_id")).alias("pos")) for df, n in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def known_country(c):
    """A blank or missing country is one of its own."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))


def keyed(df: DataFrame, rules: KeyRules, *keep: str) -> DataFrame:
    """One row per record and key."""
    fields = [F.col(f) for f in FIELDS[:-1]]
    land = F.col(FIELDS[-1]) if rules.need_country else known_country(F.col(FIELDS[-1]))
    return df.select(*keep, F.explode(blocking_keys(*fields, land, rules)).alias("key"))


def cap_postings(postings: DataFrame, settings: Settings) -> DataFrame:
    """Postings (key, source_id, pos, ...) without the excess of frequent keys."""
    rank = Window.partitionBy("key").orderBy("source_id", "pos", "entity_id")
    # Past cap + 1 rows a key's exact frequency does not matter, so no task gathers more of it.
    seen = postings.withColumn("_rank", F.row_number().over(rank)).where(F.col("_rank") <= settings.cap + 1)
    seen = seen.withColumn("_most", F.max("_rank").over(Window.partitionBy("key")))
    kept = {"first": settings.cap_take, "truncate": settings.cap, "skip": 0}[settings.cap_mode]
    return seen.where((F.col("_most") <= settings.cap) | (F.col("_rank") <= kept)).drop("_rank", "_most")


def shared_keys(anchors: DataFrame, targets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Distinct (s1_entity_id, target_entity_id, source_id, pos) that share a key."""
    probe = keyed(anchors, settings.keys, F.col("entity_id").alias("s1_entity_id"))
    build = cap_postings(keyed(targets, settings.keys, "entity_id", "source_id", "pos"), settings)
    met = probe.join(build, "key").select("s1_entity_id", F.col("entity_id").alias("target_entity_id"), "source_id", "pos")
    return met.distinct()


def _side(df: DataFrame, prefix: str) -> DataFrame:
    names = ("name", "address", "city", "postal", "country")
    return df.select(F.col("entity_id").alias(f"{prefix}_entity_id"), *(filled(F.col(f)).alias(f"{prefix}_{n}") for f, n in zip(FIELDS, names, strict=True)))


def _measured(both: DataFrame) -> DataFrame:
    """With ``MEASURES`` of both records' texts."""
    both = both.withColumn("_n", similarities(F.col("s1_name"), F.col("target_name"), "ratio", "token_sort_ratio", "token_set_ratio"))
    return both.withColumn("_a", similarities(F.col("s1_address"), F.col("target_address"), "ratio", "token_set_ratio"))


def scored(pairs: DataFrame, anchors: DataFrame, targets: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The pairs with both records' texts, the blocking score, and the measures it is made of (``MEASURES``); texts join after the pairs are distinct."""
    both = pairs.join(_side(anchors, "s1"), "s1_entity_id").join(_side(targets, "target"), "target_entity_id")
    both = _measured(both)
    score = blocking_score(F.col("_n"), F.col("_a"), F.col("s1_name"), F.col("target_name"), F.col("s1_address"), F.col("target_address"), settings.strategy)
    if settings.strategy == "postal":
        score = score + F.when((F.col("s1_postal") != "") & (F.col("s1_postal") == F.col("target_postal")), 10.0).otherwise(0.0)
    return both.withColumn("blocking_score", score)


def best(pairs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The highest scores of each anchor; ties go by source and place."""
    rank = Window.partitionBy("s1_entity_id").orderBy(F.desc("blocking_score"), "source_id", "pos", "target_entity_id")
    good = pairs.where(F.col("blocking_score") >= settings.min_score)
    return good.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= settings.max_candidates)


def candidate_pairs(anchors: DataFrame, targets: DataFrame, settings: Settings = DEFAULT, measures: bool = False) -> DataFrame:
    """The 14 columns of a candidate pair and its rank; with ``measures``, also what its score is made of, for ``pair_features``."""
    if settings.strategy != "standard":
        found = best(scored(shared_keys(anchors, targets, settings), anchors, targets, settings), settings)
        return found.select(*PAIR, "rank", *(MEASURES if measures else ()))
    from weftlink.operators import search

    found = search.with_texts(search.ranked(anchors, targets, settings), anchors, targets)
    return _measured(found) if measures else found


def index_stats(targets: DataFrame, rules: KeyRules = DEFAULT.keys) -> DataFrame:
    """Per country: targets and distinct keys."""
    keys = keyed(targets, rules, "entity_id", known_country(F.col("country_norm")).alias("country"))
    return keys.groupBy("country").agg(F.countDistinct("entity_id").alias("n_targets"), F.countDistinct("key").alias("n_keys"))


def key_sizes(targets: DataFrame, rules: KeyRules = DEFAULT.keys) -> DataFrame:
    """(key, n): how many targets a key has."""
    return keyed(targets, rules, "entity_id").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def size_summary(sizes: DataFrame) -> DataFrame:
    return sizes.agg(F.count(F.lit(1)).alias("n_keys"), F.min("n").alias("min_size"), F.max("n").alias("max_size"), F.avg("n").alias("avg_size"))


def top_keys(sizes: DataFrame, most: int = 10) -> DataFrame:
    """A report of the most frequent keys."""
    return sizes.orderBy(F.desc("n"), "key").limit(most)
