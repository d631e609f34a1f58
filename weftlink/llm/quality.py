"""Quality rules with risk-controlled thresholds.

Base measures come from whole texts. On top of the fixed base rule, one cutoff per
stratum and measure is chosen from labelled rows. The rate of good documents that the
cutoffs of a stratum reject is at most ``max_loss``, for all strata together at a
confidence of 1 - ``error``: each measure may lose its equal part of ``max_loss``, so that the
union of their rejections keeps the whole, and has its part of the error (Bonferroni over
strata and measures). Within a measure a fixed grid is tested from its laxest cutoff down to
the first whose exact binomial (Clopper-Pearson) upper bound is too high; in such a fixed
sequence every test has the measure's full level. The grid is fixed beforehand and nothing
else is fitted, so all labelled good rows are hold-out rows. The rate is that among
good documents which pass the base rule; the base rule is no part of the guarantee. A
stratum without enough good rows gets no cutoff: it rejects nothing.

Defined results: a null or empty text has no words, so the base rule rejects it; a null
stratum is a stratum of its own, apart from the empty one; repeated rows are judged alike;
ties at a cutoff are kept; labels that repeat or have no document do not count more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import code_points, cut, discard, is_space, mix, run_hashes, runs, slices, stored, table, text_bytes

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bars", "n_capitals")
#: Characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
#: So many good labelled ids may be broadcast, so that only their texts are measured to fit; beyond it all are.
BROADCAST_IDS = 200_000
#: Cutoff grids: a document is rejected when its measure exceeds the cutoff.
STEPS = (0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8)
GRID = {"symbol_rate": STEPS, "dup_line_rate": STEPS, "capital_rate": STEPS}


def _measure(batch: pa.RecordBatch, column: str) -> dict[str, np.ndarray]:
    raw, at = text_bytes(batch.column(column), False)
    n = len(at) - 1
    count = lambda who, weights=None: np.bincount(who, weights, minlength=n).astype(np.int64)
    per = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[at]).astype(np.int64)
    space = is_space(raw)
    starts, ends, doc = runs(raw, at, space)
    points = code_points(raw)
    hashes = run_hashes(raw, starts, ends)
    out = {"n_words": count(doc), "word_chars": count(doc, points[ends] - points[starts])}
    out["n_symbols"] = per(np.isin(raw, np.frombuffer(SYMBOLS, np.uint8)))
    l_starts, l_ends, l_doc = runs(raw, at, raw == 10)
    filled = np.concatenate([[0], np.cumsum(~space)])
    real = filled[l_ends] > filled[l_starts]
    l_starts, l_ends, l_doc = l_starts[real], l_ends[real], l_doc[real]
    with np.errstate(over="ignore"):
        lines = mix(run_hashes(raw, l_starts, l_ends) + l_doc.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        _, first = np.unique(lines, return_index=True)
        out["n_dup_lines"] = count(l_doc) - count(l_doc[first])
        repeated = np.zeros(len(doc), bool)
        if len(doc) >= 3:
            window = mix(mix(mix(hashes[:-2] + doc[:-2].astype(np.uint64)) + hashes[1:-1]) + hashes[2:])
            whole = np.flatnonzero(doc[:-2] == doc[2:])
            _, back, times = np.unique(window[whole], return_inverse=True, return_counts=True)
            hit = whole[times[back] > 1]
            for k in range(3):
                repeated[hit + k] = True
    out["n_repeat_words"] = count(doc, repeated)
    out["n_lines"] = count(l_doc)
    out["n_bars"] = per(raw == ord("|"))
    out["n_capitals"] = per((raw >= 65) & (raw <= 90))
    return out


def text_measures(docs: DataFrame, keep: Sequence[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of every whole text (longs)."""
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([f"`{c}` {t}" for c, t in src.dtypes if c != "_text"] + [f"{m} bigint" for m in MEASURES])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found = _measure(part, "_text")
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[m]) for m in MEASURES)], names=[*keep, *MEASURES])

    return src.mapInArrow(measure, schema)


def base_failed():
    """Fewer than 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rates() -> dict[str, F.Column]:
    part = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    return {
        "symbol_rate": part("n_symbols", "n_words"),
        "dup_line_rate": part("n_dup_lines", "n_lines"),
        "capital_rate": part("n_capitals", "word_chars"),
    }


def log_binomial_cdf(k: int, n: int, p: float) -> float:
    """Natural logarithm of P(X <= k) for X ~ Binomial(n, p)."""
    if k >= n:
        return 0.0
    i = np.arange(k + 1)
    lg = np.vectorize(math.lgamma)
    terms = math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = terms.max()
    return min(0.0, float(top + np.log(np.exp(terms - top).sum())))


def safe(rejected: int, good: int, max_loss: float, level: float) -> bool:
    """Whether the exact upper bound on the rate, at ``level``, is at most ``max_loss``.

    The Clopper-Pearson bound is at most p exactly if P(X <= rejected; good, p) <= level.
    """
    return good > 0 and log_binomial_cdf(rejected, good, max_loss) <= math.log(level)


def least_good(max_loss: float, level: float) -> int:
    """Good rows below which no cutoff is safe, even one that rejects none of them."""
    return math.ceil(math.log(level) / math.log1p(-max_loss))


def fit_cutoffs(measured: DataFrame, labels: DataFrame, stratum: str, max_loss: float = 0.02, error: float = 0.05) -> dict:
    """{stratum or None: {measure: cutoff}} from the good labelled rows.

    ``measured`` has doc_id, the stratum and the measures; ``labels`` doc_id and quality
    (1 good). Counts per grid point reach the driver only for strata with enough good rows,
    ``least_good`` at least, so there are at most (good rows / ``least_good``) of them.
    """
    good = measured.join(labels.where("quality = 1").select("doc_id").distinct(), "doc_id", "left_semi").where(~base_failed())
    aggs = [F.count(F.lit(1)).alias("good")]
    for name, rate in rates().items():
        aggs += [F.count_if(rate > c).alias(f"{name}_{i}") for i, c in enumerate(GRID[name])]
    counted = cut(good.groupBy(F.col(stratum).cast("string").alias("stratum")).agg(*aggs))
    loss, level = max_loss / len(GRID), error / (max(1, counted.count()) * len(GRID))
    out: dict = {}
    for row in counted.where(F.col("good") >= least_good(loss, level)).collect():
        for name, grid in GRID.items():
            for i in reversed(range(len(grid))):
                if not safe(row[f"{name}_{i}"], row["good"], loss, level):
                    break
                out.setdefault(row["stratum"], {})[name] = grid[i]
    return out


def method_rejects(cutoffs: dict, stratum: str):
    """The fitted rule as one column; a stratum without cutoffs rejects nothing."""
    key, out = F.col(stratum).cast("string"), F.lit(False)
    for value, own in cutoffs.items():
        for name, c in own.items():
            out = out | (key.eqNullSafe(F.lit(value).cast("string")) & (rates()[name] > c))
    return out


def judge_quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", max_loss: float = 0.02, error: float = 0.05) -> DataFrame:
    """doc_id, stratum, measures, base_failed and kept of every document.

    Texts are read once; only the measures meet the labels.
    """
    measured = stored(text_measures(docs, ["doc_id", stratum], text_col), "measures")
    cutoffs = fit_cutoffs(measured, labels, stratum, max_loss, error)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~method_rejects(cutoffs, stratum))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text_col: str = "text", max_loss: float = 0.02, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that stay, without a shuffle of texts: those with good labels fit the cutoffs, then each row is measured in passing."""
    good = cut(labels.where("quality = 1").select("doc_id", "quality").distinct())
    few = good.count() <= BROADCAST_IDS
    asked = docs.join(F.broadcast(good.select("doc_id")), "doc_id", "left_semi") if few else docs
    measured = stored(text_measures(asked, ["doc_id", stratum], text_col), "measures")
    cutoffs = fit_cutoffs(measured, good, stratum, max_loss, error)
    discard(measured)
    whole = text_measures(docs, docs.columns, text_col)
    return whole.where(~base_failed() & ~method_rejects(cutoffs, stratum)).select(*docs.columns)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    judged = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP9_SQL = r"""
with w as (
  select doc_id, lang, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines
  from documents
), win as (
  select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as times from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)
), rep as (
  select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from win where times > 1) group by doc_id
), m as (
  select w.doc_id, lang, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
  from w left join rep using (doc_id)
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    [n_symbols / greatest(n_words, 1)::double, n_dup_lines / greatest(n_lines, 1)::double, n_capitals / greatest(word_chars, 1)::double] as rates from m
), good as (
  select lang, rates from b where not base_failed and doc_id in (select doc_id from labels where quality = 1)
), steps as (
  select unnest([0.02, 0.05, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.8])::double as c
), k as (
  select lang, r, c, count(*) as n, count(*) filter (rates[r] > c) as k from good, range(1, 4) t(r), steps group by all
), tested as (
  select *, (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.02 / 3) + (n - i) * ln(1 - 0.02 / 3))) from range(0, k.k + 1) q(i))
      <= 0.05 / (3 * (select count(*) from (select distinct lang from good))) as ok from k
), safe as (
  select lang, r, min(c) as cutoff from tested x
  where ok and not exists (select 1 from tested y where y.lang is not distinct from x.lang and y.r = x.r and y.c > x.c and not y.ok) group by lang, r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (select 1 from safe where safe.lang is not distinct from b.lang and b.rates[safe.r] > safe.cutoff) as kept
from b
"""
