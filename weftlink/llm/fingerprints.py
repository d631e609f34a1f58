"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a set of weighted terms: its lower-cased words with their counts. For each
sample and term, hashes give r, c ~ Gamma(2, 1) and beta ~ U(0, 1); with weight w,

    t = floor(ln w / r + beta),   ln a = ln c - r (t - beta + 1),

and the sample is the (term, t) of least a. Two documents share a sample with
probability equal to their generalised Jaccard similarity, sum min(w) / sum max(w).

Gamma draws are quantiles at hashed levels: r from a table of ``LEVELS`` quantiles, and
ln c = ln(2 p) / 2 + g(p), which is exact in the lower tail, where the least a is found, with
the bounded g from a table.

A sample is one long: 31 bits of ln a above 32 bits naming (term, t), so the least one is a
plain ``min`` and equal texts give equal fingerprints. Samples are computed four to a
row, which keeps generated code small enough for the JVM to compile. Texts are dealt once by
doc_id; counting words and taking minima need no further shuffle.

Defined results: a null text is the empty text; texts without words have the empty
fingerprint, alike (1.0) among themselves and unlike (0.0) any other; of rows repeating a
doc_id the one with the smallest text counts; a null doc_id is an id of its own that comes first.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.llm.common import WORD_BREAK, cut, table

SAMPLES = 64
PER_ROW = 4
LEVELS = 1024
NO_ID = -(1 << 63)
_SPAN = 1 << 32


def term_weights(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, weight) of each document: hashed lower-cased words and their counts."""
    words = df.select(key, F.explode(F.split(F.lower(F.col(text_col)), WORD_BREAK)).alias("word")).where("word <> ''")
    return words.groupBy(key, F.xxhash64("word").alias("term")).agg(F.count(F.lit(1)).alias("weight"))


def gamma_quantile(p: float) -> float:
    """x with P(X <= x) = p for X ~ Gamma(2, 1), by bisection."""
    low, high = 0.0, 60.0
    for _ in range(80):
        x = (low + high) / 2
        low, high = (x, high) if 1 - (1 + x) * math.exp(-x) < p else (low, x)
    return (low + high) / 2


def _tables() -> tuple:
    """Columns of fixed arrays: quantiles of r, and g, at the middle of each level."""
    at = [(i + 0.5) / LEVELS for i in range(LEVELS)]
    r = [gamma_quantile(p) for p in at]
    g = [math.log(x) - math.log(2 * p) / 2 for x, p in zip(r, at, strict=True)]
    return tuple(F.from_json(F.lit(json.dumps([round(v, 7) for v in t])), "array<double>") for t in (r, g))


def samples(weighted: DataFrame, key: str, weights: list[str], n: int = SAMPLES) -> DataFrame:
    """(key, part, <weight>_0.. of each weight column): the least sample of each; weights of 0 take no part."""
    low, wide = F.lit(_SPAN - 1), F.explode(F.lit(list(range(n // PER_ROW)))).alias("part")
    logs = [F.ln(F.col(w).cast("double")).alias(f"ln_{w}") for w in weights]
    rows = weighted.select(key, "term", *logs, wide)
    drawn = [key, "part", *(f"ln_{w}" for w in weights)]
    r_table, g_table = _tables()
    for j in range(PER_ROW):
        x = F.xxhash64("term", F.col("part") * PER_ROW + j)
        rows = rows.withColumns({f"x{j}": x, f"y{j}": F.xxhash64(x)})
        x, y = F.col(f"x{j}"), F.col(f"y{j}")
        r = F.get(r_table, x.bitwiseAND(F.lit(LEVELS - 1)).cast("int"))
        beta = (F.shiftrightunsigned(x, 10).bitwiseAND(F.lit((1 << 20) - 1)) + F.lit(0.5)) / F.lit(float(1 << 20))
        p2 = (F.shiftrightunsigned(y, 11) + F.lit(0.5)) / F.lit(float(1 << 52))
        c = F.ln(p2) * 0.5 + F.get(g_table, F.shiftrightunsigned(y, 54).cast("int"))
        drawn += [r.alias(f"r{j}"), c.alias(f"c{j}"), beta.alias(f"b{j}"), F.shiftrightunsigned(x, 32).alias(f"z{j}")]
    rows = rows.select(*drawn)
    least = []
    for w in weights:
        for j in range(PER_ROW):
            r, c, b = F.col(f"r{j}"), F.col(f"c{j}"), F.col(f"b{j}")
            t = F.floor(F.col(f"ln_{w}") / r + b)
            order = ((c - r * (t - b + 1.0) + 80.0) * float(1 << 24)).cast("long")
            least.append(F.min(F.shiftleft(order, 32).bitwiseOR(F.col(f"z{j}").bitwiseXOR(t).bitwiseAND(low))).alias(f"{w}_{j}"))
    return rows.groupBy(key, "part").agg(*least)


def _digits(columns: list[str]):
    """Eight hex digits for each sample; the empty string where there is none."""
    return F.concat_ws("", *(F.lpad(F.lower(F.hex(F.col(c).bitwiseAND(F.lit(_SPAN - 1)))), 8, "0") for c in columns))


def signatures(weighted: DataFrame, key: str, weights: list[str], n: int = SAMPLES) -> DataFrame:
    """(key, <weight>_print ...): the fingerprint of each document under each weight column."""
    parts = samples(weighted, key, weights, n)
    parts = parts.select(key, F.struct("part", *(_digits([f"{w}_{j}" for j in range(PER_ROW)]).alias(w) for w in weights)).alias("s"))
    whole = parts.groupBy(key).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return whole.select(key, *(F.array_join(F.col(f"s.{w}"), "").alias(f"{w}_print") for w in weights))


def likeness(a, b, n: int = SAMPLES):
    """Share of equal samples of two fingerprints."""
    x, y = (F.regexp_extract_all(c, F.lit("[0-9a-f]{8}"), F.lit(0)) for c in (a, b))
    same = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v) / n
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(same)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """(id, fingerprint) of every document."""
    base = _one_per_id(docs, id_col, text_col)
    found = signatures(term_weights(base, "key", "text"), "key", ["weight"], n)
    return base.select("key").join(found, "key", "left").select(_id().alias(id_col), F.coalesce("weight_print", F.lit("")).alias("fingerprint"))


def _one_per_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.groupBy(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("key")).agg(F.min(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _id():
    return F.nullif(F.col("key"), F.lit(NO_ID))


def before_in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, prev, prev_chars): the id before each in ascending order, the last one for the first.

    Ids are dealt by ranges; only the last id of each range meets the other ranges' ones.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.groupBy(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("key")).agg(F.max(F.length(F.coalesce(F.col(text_col), F.lit("")))).alias("chars"))
    placed = cut(ids.repartitionByRange(parts, "key").select("key", "chars", F.spark_partition_id().alias("range")))
    within = Window.partitionBy("range").orderBy("key")
    last = placed.groupBy("range").agg(F.max(F.struct("key", "chars")).alias("end"))
    across = Window.orderBy("range")
    last = last.select("range", F.coalesce(F.lag("end").over(across), F.last("end").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    joined = placed.withColumn("own", F.lag(F.struct("key", "chars")).over(within)).join(F.broadcast(last), "range")
    return joined.withColumn("own", F.coalesce("own", "end")).select("key", F.col("own.key").alias("prev"), F.col("own.chars").alias("prev_chars"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness; see ``op1_fingerprints``."""
    base = _one_per_id(docs, id_col, text_col).join(before_in_order(docs, id_col, text_col), "key")
    donors = base.select(F.col("prev").alias("key"), F.expr("substring(text, 1, int(floor(prev_chars / 4)))").alias("donor"))
    pairs = base.select("key", "text", "prev").join(donors, "key")
    chars = F.length("text")
    pairs = pairs.select(
        "key",
        "prev",
        chars.cast("long").alias("n_chars"),
        F.expr("substring(text, 1, int(length(text) - floor(length(text) / 4)))").alias("front"),
        F.expr("substring(text, int(length(text) - floor(length(text) / 4)) + 1)").alias("back"),
        F.expr("substring(donor, 1, int(floor(length(text) / 4)))").alias("donor"),
    )
    # The words before the last white space of the common front count for both texts and are split once.
    head = F.regexp_extract("front", r"(?s)^(.*[\x20\x09-\x0D])", 1)
    parts = pairs.select("key", "front", "back", "donor", head.alias("head")).withColumn("rest", F.expr("substring(front, length(head) + 1)"))
    one = lambda a, b, text: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), text.alias("text"))
    parts = parts.select("key", F.explode(F.array(one(1, 1, F.col("head")), one(1, 0, F.concat("rest", "back")), one(0, 1, F.concat("rest", "donor")))).alias("p"))
    words = parts.select("key", "p.a", "p.b", F.explode(F.split(F.lower("p.text"), WORD_BREAK)).alias("word")).where("word <> ''")
    weighted = words.groupBy("key", F.xxhash64("word").alias("term")).agg(F.sum("a").alias("old"), F.sum("b").alias("new"))
    found = signatures(weighted, "key", ["old", "new"], n)
    own = pairs.select("key", "prev", "n_chars", F.sha2(F.concat("front", "donor"), 256).alias("edited_sha256")).join(found, "key", "left")
    own = own.select("key", "prev", "n_chars", "edited_sha256", F.coalesce("old_print", F.lit("")).alias("old"), F.coalesce("new_print", F.lit("")).alias("new"))
    # One row for the document itself and one for the document before it, which needs its fingerprint.
    self_row = F.struct("key", "n_chars", "edited_sha256", "old", "new", F.lit(None).cast("string").alias("next"))
    for_prev = F.struct(F.col("prev").alias("key"), F.lit(None).cast("long").alias("n_chars"), *(F.lit(None).cast("string").alias(c) for c in ("edited_sha256", "old", "new")), F.col("old").alias("next"))
    met = own.select(F.explode(F.array(self_row, for_prev)).alias("r")).select("r.*")
    met = met.groupBy("key").agg(*(F.max(c).alias(c) for c in ("n_chars", "edited_sha256", "old", "new", "next")))
    return met.select(
        _id().alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("old").alias("fingerprint"),
        F.col("new").alias("edited_fingerprint"),
        likeness(F.col("old"), F.col("new"), n).alias("near_edited"),
        likeness(F.col("old"), F.col("next"), n).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
