"""The column functions as SQL functions of a session.

Those that are plain columns become SQL functions, which Spark puts in place of their calls, so
queries that use them stay in generated code. The measures on edits are Arrow functions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from weftlink.functions import keys, lists, text
from weftlink.functions.similarity import MEASURES, ratios, token_set_ratios, token_sort_ratios

_VARIABLE = "namedlambdavariable()"


def _arrows(sql: str) -> str:
    """Spark's text of lambda functions, none within another, as ``x -> ...``."""
    opening = "lambdafunction("
    while opening in sql:
        at = sql.index(opening)
        i, depth, quoted = at + len(opening), 1, False
        begin = i
        while depth:
            c = sql[i]
            if quoted:
                i += c == "\\"
                quoted = c != "'"
            elif c == "'":
                quoted = True
            else:
                depth += (c == "(") - (c == ")")
            i += 1
        body = sql[begin : i - 1].removesuffix(f", {_VARIABLE}").replace(_VARIABLE, "x_")
        sql = f"{sql[:at]}x_ -> {body}{sql[i:]}"
    return sql


def sql_text(spark: SparkSession, column: Column, arguments: dict[str, str]) -> tuple[str, str]:
    """(SQL, type) of a column over arguments {name: type}."""
    over = spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in arguments.items()))
    made = over.select(column.alias("v"))
    return _arrows(made._jdf.queryExecution().analyzed().expressions().head().child().sql()), made.schema["v"].dataType.simpleString()


def _functions() -> dict[str, tuple[Column, dict[str, str]]]:
    c = F.col
    one = {"x": "string"}
    record = {k: "string" for k in ("name", "address", "city", "postal", "country")}
    return {
        "normalise_name": (text.name(c("x")), one),
        "normalise_country": (text.country(c("x")), one),
        "normalise_address": (text.address(c("x")), one),
        "address_text": (text.address_text(c("x")), one),
        "name_without_legal_words": (keys.without_legal_words(c("x")), one),
        "name_without_honorific": (keys.without_honorific(c("x")), one),
        "blocking_keys": (keys.blocking_keys(*(c(k) for k in record)), record),
        "id_set": (lists.id_set(c("x")), one),
        "digit_runs": (lists.digit_runs(c("x")), one),
        "entity_f05": (lists.entity_f05(c("truth"), c("found")), {"truth": "array<string>", "found": "array<string>"}),
        "token_jaccard": (lists.jaccard(text.tokens(c("x")), text.tokens(c("y"))), {"x": "string", "y": "string"}),
    }


def _score(name_a: pd.Series, name_b: pd.Series, address_a: pd.Series, address_b: pd.Series) -> pd.Series:
    """The standard blocking score of pairs of records."""
    x, y, p, q = (list(s.fillna("")) for s in (name_a, name_b, address_a, address_b))
    n = np.maximum(np.maximum(ratios(x, y), token_sort_ratios(x, y)), 0.92 * token_set_ratios(x, y))
    lacks = np.array([not s or not t for s, t in zip(p, q, strict=True)], bool)
    unnamed = np.array([not s or not t for s, t in zip(x, y, strict=True)], bool)
    a = np.where(lacks, 0.0, token_set_ratios(p, q))
    out = np.select([unnamed, lacks, n >= 80, (n < 30) & (a > 50)], [0.0, n, 0.85 * n + 0.15 * a, a], 0.60 * n + 0.40 * a)
    return pd.Series(out)


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to SQL; their names."""
    for name, (column, arguments) in _functions().items():
        body, kind = sql_text(spark, column, arguments)
        spark.sql(f"create or replace temporary function {name}({', '.join(f'{n} {t}' for n, t in arguments.items())}) returns {kind} return {body}")
    for name, f in MEASURES.items():
        spark.udf.register(name, F.pandas_udf(lambda a, b, f=f: pd.Series(f(list(a.fillna("")), list(b.fillna("")))), "double"))
    spark.udf.register("blocking_score", F.pandas_udf(lambda a, b, c, d: _score(a, b, c, d), "double"))
    return [*_functions(), *MEASURES, "blocking_score"]
