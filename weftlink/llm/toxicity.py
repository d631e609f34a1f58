"""Toxicity scores of whole texts by a recurrent network over overlapping windows.

The network (``toxic_net``) is trained on the driver on a bounded sample of labelled
documents: at most ``SAMPLE`` of each label by hash order, at most ``SAMPLE_WORDS`` words
in all and ``SAMPLE_BYTES`` bytes a document; documents beyond that or a twentieth of the words
are left out of the sample. A fifth of the
sample is held back to turn the highest window's logit into a probability. Scoring is one pass
over the texts without a shuffle; a document's score comes from the highest of all its windows.

Defined results: null or empty texts and texts without words score 0; repeated rows score
alike (to rounding: sums of floats depend on what is scored together); without labelled rows of both kinds every text has the score of the one kind, or 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.llm.common import BLOCK, discard, slices, stored, table, text_bytes, words_of
from weftlink.llm.toxic_net import Windows, logits, train

SAMPLE = 2500
SAMPLE_WORDS = 2_000_000
SAMPLE_BYTES = 1 << 20
CUTOFF = 0.3


def held_out(doc_id):
    """Whether a document is never learnt from: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """(text, label) of the sample; its size is bounded."""
    rows = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Each task keeps its first rows of either label, so no label's rows meet in one task.
    first = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for y in (0, 1)]
    picked = first[0].union(first[1])
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(picked), "doc_id")
    found = stored(found.withColumn("n", F.size(words_of(F.col("text")))).where(F.col("n").between(1, SAMPLE_WORDS // 20) & (F.octet_length("text") <= SAMPLE_BYTES)), "toxic-sample")
    # At most 2 * SAMPLE rows (more only for repeated ids) without their texts.
    sums = found.select("doc_id", "toxic", "n").withColumn("sum", F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)))
    kept = sums.where(F.col("sum") <= SAMPLE_WORDS).select("doc_id").distinct()
    out = found.join(F.broadcast(kept), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("text", "toxic").limit(2 * SAMPLE).collect()
    discard(found)
    return [(r["text"], r["toxic"]) for r in out]


def _best(net: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The highest logit of each text's windows; -inf without windows."""
    win = Windows(raw, at)
    out = np.full(len(at) - 1, -np.inf)
    np.maximum.at(out, win.doc, logits(net, win).astype(float))
    return out


def fit(sample: list[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Network and calibration from (text, label) pairs."""
    label = np.array([y for _, y in sample], np.int64)
    learn = np.arange(len(sample)) % 5 != 0
    raw, at = text_bytes(pa.array([t for (t, _), own in zip(sample, learn, strict=True) if own], pa.string()), True)
    win = Windows(raw, at)
    steps = int(200 + 700 * min(1.0, label[learn].sum() / 1000))
    net = train(win, label[learn][win.doc], win.doc, steps=steps)
    raw, at = text_bytes(pa.array([t for (t, _), own in zip(sample, learn, strict=True) if not own], pa.string()), True)
    net["scale"] = calibrate(_best(net, raw, at), label[~learn])
    return net


def calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(a, b) of the probability sigmoid(a x + b) by penalised Newton steps; a stays positive."""
    x, y = x[np.isfinite(x)], y[np.isfinite(x)]
    w = np.array([0.5, -1.0])
    if not len(x) or y.min() == y.max():
        return np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + 0.05 * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, grad), -1, 1)
    return np.array([max(w[0], 0.05), w[1]])


def score_texts(docs: DataFrame, net: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    own = docs.sparkSession.sparkContext.broadcast(net)
    kind = dict(src.dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = own.value["scale"]
        for batch in batches:
            for part in slices(batch, "_text", 4 * BLOCK):
                best = _best(own.value, *text_bytes(part.column("_text"), True))
                p = np.where(np.isfinite(best), 1 / (1 + np.exp(-np.clip(a * np.where(np.isfinite(best), best, 0) + b, -60, 60))), 0.0)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(np.round(p, 6))], names=[id_col, "score"])

    return src.mapInArrow(score, f"`{id_col}` {kind}, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = score_texts(docs, fit(training_sample(docs, table(spark, sf_dir, "labels"))))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
