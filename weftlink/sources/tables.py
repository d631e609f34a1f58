"""Tab-separated and Parquet tables of the linkage workflow.

Tab-separated files are read as lines, not as CSV: quotes are ordinary characters, short
rows are padded with empty fields, rows with too many fields are left out, and neither
``NA`` nor an empty field is a null.
"""

from __future__ import annotations

import json
import re
import tempfile
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftlink.functions.lists import id_items
from weftlink.functions.text import address_parts, country, filled, name

ENTITY = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
NORMALISED = "entity_id string, source string, name_norm string, clean_address string, street_tokens array<string>, city string, state string, postal_code string, country_norm string, raw_landmark string, raw_name string, raw_address string"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return bool(fs.exists(at))


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that all executors see: below ``spark.checkpoint.dir``, on a single machine without one a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not found.isDefined() and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = found.get() if found.isDefined() else tempfile.mkdtemp(prefix="weftlink-")
    return f"{where}/{label}-{uuid.uuid4().hex}"


def data_lines(spark: SparkSession, path: str, first: str) -> DataFrame:
    """(value) lines but for one of each file that equals the header ``first``; a line that repeats the header is data."""
    plain = F.regexp_replace(F.regexp_replace("value", "\r$", ""), "^\ufeff", "")
    lines = spark.read.text(path).select(F.col("value"), plain.alias("_plain"), F.col("_metadata.file_path").alias("_file"))
    # Only lines that read like the header meet in a task: one a file, but for faulty ones.
    again = Window.partitionBy("_file").orderBy("value")
    heads = lines.where(F.col("_plain") == first).withColumn("_n", F.row_number().over(again)).where("_n > 1")
    return lines.where(F.col("_plain") != first).select("value").union(heads.select("value"))


def header(spark: SparkSession, path: str) -> str | None:
    """The first line of a file."""
    row = spark.read.text(path).first()
    return None if row is None else row[0].rstrip("\r").removeprefix("\ufeff")


def read_tsv(spark: SparkSession, path: str, columns: Iterable[str], limit: int | None = None) -> DataFrame:
    """The named columns, all text; FileNotFoundError without the file, KeyError without a column. limit: rows for a smoke run."""
    columns = list(columns)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    first = header(spark, path) or ""
    names = first.split("\t")
    missing = [c for c in columns if c not in names]
    if missing:
        raise KeyError(f"{path} lacks {missing}")
    lines = data_lines(spark, path, first).select(F.regexp_replace("value", "\r$", "").alias("value")).where("value <> ''")
    fields = F.split("value", "\t", -1)
    rows = lines.where(F.size(fields) <= len(names))
    out = rows.select(*(filled(F.get(fields, F.lit(names.index(c)))).alias(c) for c in columns))
    return out.limit(limit) if limit else out


def read_entities(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_tsv(spark, path, ENTITY, limit)


def read_truth(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    return read_tsv(spark, path, TRUTH, limit)


def normalise_entities(raw: DataFrame, source: str, keep: Iterable = ()) -> DataFrame:
    """The twelve normalised columns of raw entity rows, and further ones; works on batches and streams."""
    parts = address_parts(F.col("business_address"))
    made = {
        "entity_id": filled(F.col("entity_id")),
        "source": F.lit(source),
        "name_norm": name(F.col("business_name")),
        **parts,
        "country_norm": country(F.col("country")),
        "raw_name": filled(F.col("business_name")),
        "raw_address": filled(F.col("business_address")),
    }
    order = [c.split()[0] for c in NORMALISED.split(", ")]
    return raw.select(*(made[c].alias(c) for c in order), *keep)


def normalise_truth(raw: DataFrame) -> DataFrame:
    """Truth lists with their number of items, repeats counted, and whether there is none."""
    n = F.size(id_items(F.col("matched_entity_ids")))
    return raw.select("source1_entity_id", filled(F.col("matched_entity_ids")).alias("matched_entity_ids"), n.alias("match_count"), (n == 0).alias("is_singleton"))


def recover(spark: SparkSession, path: str) -> None:
    """Put back the table that a writer had moved away when it was lost."""
    (to, fs), (old, _) = _fs(spark, path), _fs(spark, f"{path.rstrip('/')}.before")
    if fs.exists(old):
        if fs.exists(to):
            fs.delete(old, True)
        else:
            fs.rename(old, to)


def write_parquet(df: DataFrame, path: str, partition_by: Iterable[str] = ()) -> dict:
    """Snappy Parquet in place of what is there, after it is complete; the report has rows, seconds and MB."""
    from pyspark.sql import Observation

    spark, began, seen = df.sparkSession, time.time(), Observation()
    staged, before = (f"{path.rstrip('/')}.{x}" for x in ("writing", "before"))
    recover(spark, path)
    writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "snappy")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged)
    (at, fs), (to, _), (old, _) = (_fs(spark, x) for x in (staged, path, before))
    # Two renames: at any time the old or the new table is whole, here or under the name that ``recover`` knows.
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"{path} could not be moved away")
    if not fs.rename(at, to):
        raise OSError(f"{staged} could not be moved to {path}")
    fs.delete(old, True)
    seconds = time.time() - began
    rows = seen.get["rows"]
    return {"rows": rows, "seconds": seconds, "rows_per_second": rows / max(seconds, 1e-9), "mb": fs.getContentSummary(to).getLength() / 1e6}


def read_normalised(spark: SparkSession, path: str, columns: Iterable[str] | None = None, source_id: int | None = None) -> DataFrame:
    """A normalised table, pruned to ``columns``; with ``source_id`` also (source_id, pos), the row's place in its source."""
    recover(spark, path)
    df = spark.read.parquet(path)
    chosen = list(columns) if columns else df.columns
    if source_id is None:
        return df.select(*chosen)
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*chosen, F.lit(source_id).alias("source_id"), pos.alias("pos"))


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    """(id): distinct first fields below the header of a text file, or the ids of a Parquet table."""
    if path.rstrip("/").endswith(".parquet"):
        df = spark.read.parquet(path)
        return df.select(F.trim(F.col(df.columns[0]).cast("string")).alias("id")).distinct()
    first = header(spark, path)
    lines = data_lines(spark, path, first or "").where(F.trim("value") != "")
    return lines.select(F.trim(F.substring_index("value", "\t", 1)).alias("id")).distinct()


def read_match_targets(spark: SparkSession, folder: str, names: Iterable[str] = ("test_source2.tsv", "test_source3.tsv")) -> DataFrame | None:
    """Ids that may be matched, or None if one of the files is missing."""
    paths = [f"{folder.rstrip('/')}/{n}" for n in names]
    if not all(exists(spark, p) for p in paths):
        return None
    out = read_id_set(spark, paths[0])
    for p in paths[1:]:
        out = out.union(read_id_set(spark, p))
    return out.distinct()


def read_id_lists(spark: SparkSession, path: str) -> DataFrame:
    """(line, has_tab, id, ids) of the rows below the header of a results file; ids are neither trimmed nor dropped, blank rows go."""
    first = header(spark, path)
    lines = data_lines(spark, path, first or "").where(F.trim("value") != "")
    rest = F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)")).otherwise("")
    ids = F.when(F.trim(rest) == "", F.array().cast("array<string>")).otherwise(F.split(rest, ","))
    return lines.select(F.col("value").alias("line"), (F.instr("value", "\t") > 0).alias("has_tab"), F.substring_index("value", "\t", 1).alias("id"), ids.alias("ids"))


def write_results(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Two columns as tab-separated text with a header; an empty list is an empty field, nothing is quoted."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").csv(path)


def inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes) of all files below a folder."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return read.select("path", F.col("length").alias("bytes"))


def find_dataset(spark: SparkSession, root: str, names: Iterable[str]) -> str | None:
    """The first folder below ``root``, in order of its path, that holds files of all these names; None if none does."""
    names = list(names)
    at, fs = _fs(spark, root)
    if not fs.exists(at):
        return None
    held: dict[str, set[str]] = {}
    files = fs.listFiles(at, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName() in names:
            held.setdefault(path.getParent().toString(), set()).add(path.getName())
    return min((folder for folder, some in held.items() if len(some) == len(set(names))), default=None)


def zip_results(files: dict[str, str], target: str) -> None:
    """Pack local files under the given names."""
    import zipfile

    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, path in files.items():
            z.write(path, name)


def write_sample(rows: list[dict], text_path: str, json_path: str) -> None:
    """A few pairs as blocks of text and as JSON, for reading."""
    with open(text_path, "w", encoding="utf-8") as f:
        for row in rows:
            f.write("\n".join(f"{k}: {v}" for k, v in row.items()) + "\n\n")
    with open(json_path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=1)
