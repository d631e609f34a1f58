"""Checks of result files: ten rules, as counts with examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.sources.tables import exists, header, read_id_lists

#: Headers of the two result files.
HEADERS = {"matched": ("source1_entity_id", "matched_entity_ids"), "candidate": ("source1_entity_id", "candidate_entity_ids")}
#: Examples named in a message.
SHOWN = 5


def duplicate_anchors(lists: DataFrame) -> DataFrame:
    return lists.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")


def repeated_in_list(lists: DataFrame) -> DataFrame:
    return lists.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("id").distinct()


def self_matches(lists: DataFrame) -> DataFrame:
    return lists.select(F.explode(F.filter("ids", lambda x: x.startswith("S1-"))).alias("id")).distinct()


def wrong_prefixes(lists: DataFrame) -> DataFrame:
    bad = F.filter("ids", lambda x: ~(x.startswith("S1-") | x.startswith("S2-") | x.startswith("S3-")))
    return lists.select(F.explode(bad).alias("id")).distinct()


def unknown_targets(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """Listed ids that no target has."""
    return lists.select(F.explode("ids").alias("id")).where(F.col("id").startswith("S2-") | F.col("id").startswith("S3-")).distinct().join(targets, "id", "left_anti")


def missing_anchors(lists: DataFrame, required: DataFrame) -> DataFrame:
    return required.join(lists.select("id").distinct(), "id", "left_anti")


def unexpected_anchors(lists: DataFrame, required: DataFrame) -> DataFrame:
    return lists.select("id").distinct().join(required, "id", "left_anti")


def not_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Anchors with a match that is not among their candidates."""
    gather = lambda df, name: df.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias(name))
    both = gather(matched, "m").join(gather(candidates, "c"), "id", "left").withColumn("c", F.coalesce("c", F.array().cast("array<string>")))
    return both.where(F.size(F.array_except("m", "c")) > 0).select("id")


def row_counts(lists: DataFrame) -> DataFrame:
    empty = F.size("ids") == 0
    return lists.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(empty).alias("n_empty"), F.count_if(~empty).alias("n_filled"))


def _say(problems: list[str], checks: dict[str, DataFrame]) -> None:
    """A message for each check that found something: how often, and the first few. Two jobs serve all checks."""
    every = None
    for n, found in enumerate(checks.values()):
        part = found.select(F.lit(n).alias("n"), F.col(found.columns[0]).alias("value"))
        every = part if every is None else every.union(part)
    counts = {r["n"]: r["count"] for r in every.groupBy("n").count().collect()}
    if not counts:
        return
    ranked = every.withColumn("_rank", F.row_number().over(Window.partitionBy("n").orderBy("value"))).where(F.col("_rank") <= SHOWN)
    shown: dict[int, list[str]] = {}
    for row in sorted(ranked.collect(), key=lambda r: (r["n"], r["_rank"])):
        shown.setdefault(row["n"], []).append(str(row["value"]))
    for n, what in enumerate(checks):
        if n in counts:
            problems.append(f"{what}: {counts[n]} ({', '.join(shown[n])}{', ...' if counts[n] > SHOWN else ''})")


def check_file(spark: SparkSession, path: str, kind: str, required: DataFrame, targets: DataFrame | None, errors: list[str]) -> DataFrame | None:
    """The rows of a results file, or None if it cannot be read; problems go to ``errors``."""
    if not exists(spark, path):
        errors.append(f"file not found: {path}")
        return None
    first = header(spark, path)
    if first is None:
        errors.append(f"{path} is empty")
        return None
    if "\t" not in first:
        errors.append(f"{path} has commas, not tabs, between columns" if "," in first else f"{path} has no tab in its header")
        return None
    if tuple(c.strip().lower() for c in first.split("\t")) != HEADERS[kind]:
        errors.append(f"{path} has header {first!r}")
        return None
    lines = read_id_lists(spark, path)
    lists = lines.where("has_tab")
    checks = {
        "rows without a tab": lines.where("not has_tab").select("line"),
        "anchors on several rows": duplicate_anchors(lists),
        "lists with a repeated id": repeated_in_list(lists),
        "S1- ids among the matches": self_matches(lists),
        "ids with a wrong prefix": wrong_prefixes(lists),
        "missing anchors": missing_anchors(lists, required),
        "unexpected anchors": unexpected_anchors(lists, required),
    }
    if targets is not None:
        checks["unknown target ids"] = unknown_targets(lists, targets)
    _say(errors, checks)
    return lists


def validate(spark: SparkSession, matched_path: str, candidate_path: str, required: DataFrame, targets: DataFrame | None = None, candidates_needed: bool = False) -> tuple[list[str], list[str]]:
    """(errors, warnings). ``required``: (id) anchors; ``targets``: (id) to check existence, or None."""
    errors: list[str] = []
    warnings: list[str] = []
    matched = check_file(spark, matched_path, "matched", required, targets, errors)
    if not exists(spark, candidate_path):
        (errors if candidates_needed else warnings).append(f"file not found: {candidate_path}")
        return errors, warnings
    candidates = check_file(spark, candidate_path, "candidate", required, targets, errors)
    if matched is not None and candidates is not None:
        _say(warnings, {"anchors with a match that is no candidate": not_candidates(matched, candidates)})
    return errors, warnings
