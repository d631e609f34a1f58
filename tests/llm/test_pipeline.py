"""The pipeline's stages against brute force on a small fixture, and on empty input."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftlink.llm import tokens

from .conftest import SCHEMA, words
from .test_ops import slow_components, slow_gone, slow_measures

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    texts = ["\n".join(words(rng, rng.randrange(20, 60)) for _ in range(3)) for _ in range(80)]
    for i in range(6):
        texts += [texts[i], texts[i + 10].replace("alpha", "omega", 1), texts[i + 20] + "\n" + texts[i + 30].split("\n")[1]]
        one = texts[i + 40].split(" ")
        one[::9] = ["edited"] * len(one[::9])
        texts.append(" ".join(one))
        texts.append(" ".join(f"{x}###" for x in words(rng, 70).split()))
    texts += [None, "", "short text", "same words here " * 60]
    rows = [(i, t, None if i % 9 == 0 else "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    out = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1)).write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(not (t or "").count("###")), int(i % 11 == 0)) for i, t in enumerate(texts) if i % 2]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def pairs(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = pairs(docs)
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality"](spark, docs, folder)
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    now = pairs(kept)
    for d, t in before.items():
        n, *_, repeated = slow_measures(t)
        if n < 50 or 100 * repeated > 50 * n:
            assert d not in now
        elif "###" not in (t or ""):
            assert now[d] == t
    lines = pairs(steps["lines"](spark, kept, folder))
    gone = slow_gone(sorted(now.items()))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in now.items()}
    assert lines == {d: t for d, t in want.items() if t.strip()} and len(lines) < len(now)
    # The near stage by itself, on input that still has near copies.
    near = pairs(steps["near"](spark, kept, folder))
    assert set(near) == {d for d, (_, c) in slow_components(sorted(now.items()), 5, 80, 100).items() if d == c} and len(near) < len(now)
    mixed = collections.Counter(r.doc_id for r in steps["mixing"](spark, kept, folder).collect())
    assert set(mixed) <= set(now) and len(mixed) > 0.8 * len(now)


def test_mixing_shares(spark, tmp_path, monkeypatch):
    # 60 % of the documents are of low quality; the stage's expected tokens have the target shares all the same.
    rng = random.Random(22)
    kind = [("good", 1, 0), ("spam", 0, 0), ("vile", 1, 1)]
    labels, rows = [], []
    for i in range(300):
        name, q, t = kind[0 if i % 10 < 3 else 1 if i % 10 < 9 else 2]
        text = " ".join(f"{name}{rng.randrange(30)}" if rng.random() < 0.5 else x for x in words(rng, 60).split())
        rows.append((i, text, "en", "src0", len(text)))
        labels.append((i, q, t))
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    made, mix = [], corpus_pipeline.mix_documents
    monkeypatch.setattr(corpus_pipeline, "mix_documents", lambda *a, **k: made.append(mix(*a, **k)) or made[-1])
    mixed = collections.Counter(r.doc_id for r in corpus_pipeline.mixing_stage(spark, docs, str(tmp_path)).collect())
    got = made[0].collect()
    total = sum(r.rate * r.n_tokens for r in got)
    want = {"high": 0.93, "low": 0.02, "toxic": 0.05}
    for d, share in want.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) / total == pytest.approx(share, abs=1e-3)
    assert all(mixed[r.doc_id] == r.copies for r in got) and all(r.rate >= 1 for r in got if r.p_high > 0.95)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    own = tokens.encoder(tokens.vocabulary("byte_bpe_50k.json"))
    sums = collections.Counter()
    for r in got:
        sums[r.doc_id] += r.length
    sizes = {r.doc_id: r.doc_tokens for r in got}
    assert got and all(n % sizes[d] == 0 for d, n in sums.items())
    windows = collections.Counter()
    for r in got:
        windows[r.sequence_id] += r.length
    assert all(n <= 2048 and n & (n - 1) == 0 for n in windows.values()) and own.ids("a").dtype == np.uint32


def test_empty(spark, folder, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
