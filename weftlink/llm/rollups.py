"""Token totals by source, language and tokenizer version, maintained by signed batches.

A batch of changes (insert, delete, revise) is reduced to signed sums per group, written to a
folder of its own, and committed by one small record that is renamed to the hash of the
batch id: of several writers of one id one wins, the others see its record. Committing a
batch id again changes nothing; under another content it is an error. ``compact`` folds
all committed batches into a base, a table of totals with a table of the ids in it; the newest
base and the records beside it are the state, so totals read one base and at most
``COMPACT_AFTER`` batches, and a record that is also in the base counts once.

Defined results: null text counts 0 tokens; null source or language is a group of its
own; a revise row carries the old count and moves only the difference; null counts are 0;
``times`` repeats a row, where there is such a column; an unknown or null op is an error and
nothing is committed; a group whose sums are all zero stays with zeros; an empty batch
commits and adds nothing; a rename that fails without another's record is an error.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import discard, shared_dir, stored, table
from weftlink.llm.tokens import counts, vocabulary

GROUP = ("source", "lang", "tokenizer_version")
STATE = "source string, lang string, tokenizer_version string, n_docs bigint, n_tokens bigint"
IDS = "key string, digest string"
OPS = ("insert", "delete", "revise")
#: So many committed batches beside the base; the next commit folds them first.
COMPACT_AFTER = 64


def count_tokens(docs: DataFrame, tokenizers: Mapping[str, str], keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` and (tokenizer_version, tokens) of each document under each tokenizer {version: file}."""
    src = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in src.dtypes if c != "_text"), "tokenizer_version string", "tokens bigint"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for version, path in tokenizers.items():
                own = [*(batch.column(c) for c in keep), pa.array([version] * len(batch), pa.string()), pa.array(counts(texts, path))]
                yield pa.RecordBatch.from_arrays(own, names=[*keep, "tokenizer_version", "tokens"])

    return src.mapInArrow(count, schema)


class Rollup:
    """The state in ``folder``, which all executors share: ``data`` (sums, one folder a batch or base), ``batches`` and ``bases`` (records)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("data", "batches", "bases", "staged"):
            self._fs.mkdirs(self._path(name))

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @staticmethod
    def key(batch_id: str) -> str:
        """Name of a batch's record, whatever the length of its id."""
        return hashlib.sha256(batch_id.encode()).hexdigest()

    def _names(self, where: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(where)))

    def _record(self, name: str) -> dict | None:
        """The record of this name; None where there is none (any more)."""
        if not self._fs.exists(self._path(name)):
            return None
        try:
            stream = self._fs.open(self._path(name))
        except Exception:
            if self._fs.exists(self._path(name)):
                raise
            return None  # folded into a base between the two calls
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, name: str, record: dict) -> dict:
        """Put a record in place unless there is one of this name; the record that is there."""
        staged = self._path(f"staged/{uuid.uuid4().hex}")
        stream = self._fs.create(staged, False)
        stream.write(bytearray(json.dumps(record).encode()))
        stream.close()
        moved = not self._fs.exists(self._path(name)) and self._fs.rename(staged, self._path(name))
        there = self._record(name)
        if not moved:
            self._fs.delete(staged, False)
        if there is None:
            raise OSError(f"{self.folder}/{name} could not be written")
        return there

    def _base(self) -> tuple[int, dict | None]:
        """Number and record of the newest base."""
        names = self._names("bases")
        return (int(names[-1]), self._record(f"bases/{names[-1]}")) if names else (0, None)

    def _sums(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*(f"{self.folder}/data/{n}" for n in names))

    def _folded(self, base: dict | None) -> DataFrame:
        if base is None:
            return self.spark.createDataFrame([], IDS)
        return self.spark.read.schema(IDS).parquet(f"{self.folder}/data/{base['ids']}")

    def committed(self, batch_id: str) -> str | None:
        """Digest of a committed batch's sums, or None. The record is looked for before the base, which takes its place."""
        key = self.key(batch_id)
        record = self._record(f"batches/{key}")
        if record is not None:
            return record["digest"]
        row = self._folded(self._base()[1]).where(F.col("key") == key).first()
        return row["digest"] if row else None

    @staticmethod
    def deltas(changes: DataFrame) -> DataFrame:
        """Signed sums of changes (op, source, lang, tokenizer_version, tokens, old_tokens[, times])."""
        new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        times = F.col("times") if "times" in changes.columns else F.lit(1)
        wrong = F.raise_error(F.concat(F.lit("unknown op: "), F.coalesce("op", F.lit("null")))).cast("long")
        docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong)
        tokens = F.when(F.col("op") == "insert", new).when(F.col("op") == "delete", -new).otherwise(new - old)
        return changes.groupBy(*GROUP).agg(F.sum(docs * times).cast("long").alias("n_docs"), F.sum(tokens * times).cast("long").alias("n_tokens"))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Whether the batch was added; False if it was there already."""
        if len(self._names("batches")) >= COMPACT_AFTER:
            self.compact()
        key, own = self.key(batch_id), uuid.uuid4().hex
        self.deltas(changes).coalesce(1).write.parquet(f"{self.folder}/data/{own}")
        row = self._sums([own]).agg(F.count(F.lit(1)), F.sum(F.xxhash64(*GROUP, "n_docs", "n_tokens").cast("decimal(38,0)"))).first()
        digest = f"{row[0]}:{row[1]}"
        known = self.committed(batch_id)
        if known is None:
            there = self._publish(f"batches/{key}", {"id": batch_id, "digest": digest, "data": own})
            if there["data"] == own:
                return True
            known = there["digest"]
        self._fs.delete(self._path(f"data/{own}"), True)
        if known != digest:
            raise ValueError(f"batch {batch_id!r} was committed with other content")
        return False

    def _live(self, base: dict | None) -> dict[str, dict]:
        """{key: record} of the batches that the base does not hold: at most ``COMPACT_AFTER`` and those of other writers meanwhile."""
        records = {k: r for k in self._names("batches") if (r := self._record(f"batches/{k}")) is not None}
        if base is not None and records:
            held = {r["key"] for r in self._folded(base).where(F.col("key").isin(list(records))).collect()}
            records = {k: r for k, r in records.items() if k not in held}
        return records

    def _state(self) -> tuple[int, dict | None, dict[str, dict]]:
        """The newest base and the batches beside it, read again if a base appears meanwhile."""
        while True:
            number, base = self._base()
            live = self._live(base)
            if self._base()[0] == number:
                return number, base, live

    def totals(self) -> DataFrame:
        """Sums of all committed batches."""
        _, base, live = self._state()
        read = self._sums(([base["data"]] if base else []) + [r["data"] for r in live.values()])
        return read.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def compact(self) -> bool:
        """Fold the committed batches into a new base; False if there is none or another writer was first.

        The base appears by one rename. Then its batches' records go, and their sums and the bases before the last one.
        """
        number, base, live = self._state()
        if not live:
            return False
        data, ids = uuid.uuid4().hex, uuid.uuid4().hex
        read = self._sums(([base["data"]] if base else []) + [r["data"] for r in live.values()])
        read.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.folder}/data/{data}")
        own = self.spark.createDataFrame([(k, r["digest"]) for k, r in live.items()], IDS)
        self._folded(base).union(own).write.parquet(f"{self.folder}/data/{ids}")
        there = self._publish(f"bases/{number + 1:012d}", {"data": data, "ids": ids, "folded": [r["data"] for r in live.values()]})
        if there["data"] != data:
            for name in (data, ids):
                self._fs.delete(self._path(f"data/{name}"), True)
            return False
        for key in live:
            self._fs.delete(self._path(f"batches/{key}"), False)
        # Readers of the base before this one may still be at work; what only older ones needed goes.
        for name in self._names("bases"):
            if int(name) < number:
                gone = self._record(f"bases/{name}")
                self._fs.delete(self._path(f"bases/{name}"), False)
                for part in (gone["data"], gone["ids"], *gone["folded"]) if gone else ():
                    self._fs.delete(self._path(f"data/{part}"), True)
        return True


def history(docs: DataFrame, tokenizers: Mapping[str, str], folder: str) -> Rollup:
    """Four commits over whole tables: estimates, exact counts as revisions, deletion of later exact copies, and one batch again."""
    spark = docs.sparkSession
    estimate = F.floor(F.length(F.coalesce("text", F.lit(""))) / 4)
    src = docs.select("doc_id", "source", "lang", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), estimate.alias("estimate"))
    counted = stored(count_tokens(src, tokenizers, ("doc_id", "source", "lang", "digest", "estimate")), "counts")
    none = F.lit(0).cast("long")
    log = Rollup(spark, folder)
    inserts = counted.select(F.lit("insert").alias("op"), *GROUP, F.col("estimate").alias("tokens"), none.alias("old_tokens"))
    revised = counted.select(F.lit("revise").alias("op"), *GROUP, "tokens", F.col("estimate").alias("old_tokens"))
    # Copies come after a smaller doc_id with the same text; of rows that repeat an id, none is deleted for the other.
    # A text of very many copies is one row a group before it meets its first id.
    ids = counted.where("doc_id is not null").groupBy("digest", *GROUP, "doc_id").agg(F.count(F.lit(1)).alias("k"), F.first("tokens").alias("tokens"))
    texts = ids.groupBy("digest", *GROUP).agg(F.sum("k").alias("k"), F.min(F.struct("doc_id", "k")).alias("low"), F.first("tokens").alias("tokens"))
    first = texts.groupBy("digest").agg(F.min("low.doc_id").alias("first"))
    times = F.col("k") - F.when(F.col("low.doc_id") == F.col("first"), F.col("low.k")).otherwise(0)
    copies = texts.join(first, "digest").select(F.lit("delete").alias("op"), *GROUP, "tokens", none.alias("old_tokens"), times.alias("times")).where("times > 0")
    log.commit("load", inserts)
    log.commit("recount", revised)
    log.commit("copies", copies)
    log.commit("recount", revised)
    discard(counted)
    return log


def op10_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after loading all documents, revising their counts and deleting exact copies."""
    tokenizers = {v: vocabulary(v) for v in ("byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken")}
    return history(table(spark, sf_dir, "documents"), tokenizers, f"{shared_dir(spark)}/weftlink-rollup-{uuid.uuid4().hex}").totals()
