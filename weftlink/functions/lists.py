"""Id lists and the F0.5 of one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftlink.functions.text import filled, strip


def id_items(c: Column) -> Column:
    """Trimmed, non-empty items of a comma list, repeats included."""
    return F.filter(F.transform(F.split(filled(c), ","), strip), lambda x: x != "")


def id_set(c: Column) -> Column:
    """Distinct items of a comma list; none for null."""
    return F.array_distinct(id_items(c))


def entity_f05(truth: Column, found: Column) -> Column:
    """F0.5 of one record's found ids; with no true ids, 1 exactly if none is found."""
    hits = F.size(F.array_intersect(truth, found))
    score = 1.25 * hits / (0.25 * F.size(truth) + F.size(found))
    return F.when((F.size(truth) == 0) & (F.size(found) == 0), 1.0).when((F.size(truth) == 0) | (F.size(found) == 0) | (hits == 0), 0.0).otherwise(score)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def digit_runs(c: Column) -> Column:
    """Distinct runs of digits."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1)))
