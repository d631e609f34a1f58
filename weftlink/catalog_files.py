"""Queries that write files, read them again and give what was read; and those on samples, folds and filters.

The files hold the entity view and the lists of ``catalog``, in a fresh folder that all executors see.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink import catalog
from weftlink.operators import candidates, model, profile, recall, search, validate
from weftlink.plans.resolve import write_lists
from weftlink.plans.settings import PREDICT
from weftlink.sources import tables


def _tsv_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw entities whose fields hold no tabs or line ends."""
    raw = catalog.raw_entities(spark, sf_dir)
    return raw.select(*(F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\r\n]", " ").alias(c) for c in tables.ENTITY))


def _write_tsv(df: DataFrame, path: str) -> str:
    df.write.option("sep", "\t").option("header", True).option("emptyValue", "").option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _entity_file(spark: SparkSession, sf_dir: str) -> str:
    return _write_tsv(_tsv_entities(spark, sf_dir).coalesce(1), f"{tables.scratch(spark, 'files')}/train_source1.tsv")


def io_entity_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_entities(spark, _entity_file(spark, sf_dir))


def io_truth_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = catalog.order_lists(spark, sf_dir).select("source1_entity_id", F.col("truth").alias("matched_entity_ids"))
    path = _write_tsv(lists.coalesce(1), f"{tables.scratch(spark, 'files')}/truth.tsv")
    return tables.normalise_truth(tables.read_truth(spark, path))


def io_row_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a trial run of 100 reads: a feature of the reader."""
    read = tables.read_entities(spark, _entity_file(spark, sf_dir), 100)
    return read.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("entity_id").alias("n_ids"))


def io_missing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader says of a file or a column that is not there."""
    path, said = _entity_file(spark, sf_dir), []
    for case, read, at in (("file", tables.read_entities, f"{path}.none"), ("column", tables.read_truth, path)):
        try:
            read(spark, at)
        except (FileNotFoundError, KeyError) as error:
            said.append((case, type(error).__name__))
    return spark.createDataFrame(said, "missing string, error string")


def _normalised(spark: SparkSession, sf_dir: str) -> str:
    """A table that took the place of another one."""
    path = f"{tables.scratch(spark, 'files')}/train_source1.parquet"
    raw = catalog.raw_entities(spark, sf_dir)
    for part in (raw.where("doc_id % 7 = 0"), raw):
        tables.write_parquet(tables.normalise_entities(part, "source1"), path)
    return path


def io_parquet_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows and columns of the later table."""
    made = tables.read_normalised(spark, _normalised(spark, sf_dir))
    return made.select("entity_id", "source", "name_norm", "clean_address", F.array_join("street_tokens", " ").alias("street"), "city", "state", "postal_code", "country_norm", "raw_landmark", "raw_name", "raw_address")


def io_parquet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the writer reports: rows, and whether time, rate and size are there."""
    path = f"{tables.scratch(spark, 'files')}/t.parquet"
    got = tables.write_parquet(catalog.entities(spark, sf_dir).drop("source_no", "pos"), path)
    return spark.createDataFrame([(got["rows"], got["seconds"] > 0 and got["rows_per_second"] > 0 and got["mb"] > 0)], "n_rows bigint, measured boolean")


def io_pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a search, with source and a distinct place for every row."""
    read = tables.read_normalised(spark, _normalised(spark, sf_dir), ["entity_id", *candidates.FIELDS], 2)
    return read.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("pos").alias("n_places"), F.sum("source_id").alias("sources"), F.count("city").alias("n_cities"), F.max("name_norm").alias("last_name"))


def io_result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both result files as they are read by the checks."""
    folder = tables.scratch(spark, "files")
    lists = catalog.order_lists(spark, sf_dir).select("source1_entity_id", F.col("truth").alias("matched_entity_ids"), F.col("pred").alias("candidate_entity_ids"))
    write_lists(lists, folder, single_file=True)
    read = lambda name: tables.read_id_lists(spark, f"{folder}/{name}.tsv")
    out = read("matching_results").select(F.lit("matching").alias("file"), "has_tab", "id", F.array_join("ids", ",").alias("ids"))
    return out.union(read("candidate_pairs").select(F.lit("candidate"), "has_tab", "id", F.array_join("ids", ",")))


def _targets(spark: SparkSession, sf_dir: str) -> str:
    folder = tables.scratch(spark, "files")
    raw = catalog.raw_entities(spark, sf_dir)
    for n in (2, 3):
        _write_tsv(raw.where(F.col("source_no") == n).select("entity_id", "country"), f"{folder}/test_source{n}.tsv")
    return folder


def io_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of a text file and of a Parquet table."""
    folder = _targets(spark, sf_dir)
    text = tables.read_id_set(spark, f"{folder}/test_source2.tsv")
    raw = catalog.raw_entities(spark, sf_dir)
    raw.select(F.concat(F.lit(" "), "entity_id").alias("entity_id")).union(raw.select("entity_id")).write.parquet(f"{folder}/ids.parquet")
    return text.select(F.lit("text").alias("kind"), "id").union(tables.read_id_set(spark, f"{folder}/ids.parquet").select(F.lit("parquet"), "id"))


def io_match_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.read_match_targets(spark, _targets(spark, sf_dir))


def io_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of text below a folder, and the folder that discovery finds for them."""
    folder = _targets(spark, sf_dir)
    files = tables.inventory(spark, folder, "part-*").where("bytes > 0")
    names = files.select(F.element_at(F.split("path", "/"), -2).alias("name")).distinct()
    # Each table is a folder of part files here; their markers are what discovery can go by.
    found = tables.find_dataset(spark, folder, ["_SUCCESS"])
    return names.withColumn("discovered", F.lit(found is not None and found.endswith("test_source2.tsv")))


def io_scan_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit's looks at a file: its header's columns, and its countries from one column alone."""
    path = _entity_file(spark, sf_dir)
    head = spark.createDataFrame([(c, -1) for c in (tables.header(spark, path) or "").split("\t")], "value string, n bigint")
    return profile.value_counts(tables.read_tsv(spark, path, ["country"]), "country").select(F.col("country").alias("value"), "n").union(head)


def validate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, n_errors, n_warnings): what the checks say of whole files with faults that ``validate_findings`` cannot show."""
    folder = tables.scratch(spark, "files")
    ids = [f"S1-{i}" for i in range(4)]
    required = spark.createDataFrame([(i,) for i in ids], "id string")
    head, rows = "source1_entity_id\tmatched_entity_ids", [f"{i}\tS2-{n}" for n, i in enumerate(ids)]
    files = {
        "good": [head, *rows],
        "commas": ["source1_entity_id,matched_entity_ids", *rows],
        "no_tab": ["source1_entity_id", *rows],
        "wrong_header": ["id\tmatches", *rows],
        "row_without_tab": [head, *rows[:3], "S1-3"],
        "header_twice": [head, head, *rows],
        "repeated_id": [head, "S1-0\tS2-0,S2-0", *rows[1:]],
        "not_candidate": [head, "S1-0\tS2-3", *rows[1:]],
    }
    targets = spark.createDataFrame([(f"S2-{n}",) for n in range(4)], "id string")
    write = lambda name, lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{folder}/{name}")
    write("candidates", ["source1_entity_id\tcandidate_entity_ids", *rows])
    out = []
    for name, lines in files.items():
        write(name, lines)
    for name in (*files, "absent"):
        # The second file is optional: without it there is one warning.
        second = "candidates" if name == "not_candidate" else "absent"
        errors, warnings = validate.validate(spark, f"{folder}/{name}", f"{folder}/{second}", required, targets)
        out.append((name, len(errors), len(warnings)))
    return spark.createDataFrame(out, "name string, n_errors int, n_warnings int")


def grouped_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of every candidate pair: its anchor's."""
    return catalog._joined(spark, sf_dir).select("s1_entity_id", "target_entity_id", model.fold(F.col("s1_entity_id")).alias("fold"))


def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled pairs of a sample of anchors from chosen countries, with two of the features."""
    a, t = catalog.anchors_and_targets(spark, sf_dir)
    links = catalog.true_links(spark, sf_dir).groupBy("s1_entity_id").agg(F.array_join(F.sort_array(F.collect_list("target_entity_id")), ",").alias("m"))
    truth = links.select(F.col("s1_entity_id").alias("source1_entity_id"), F.col("m").alias("matched_entity_ids"))
    rows, _ = model.training_set(a, t, truth, sample_size=100, countries=["de", "fr"])
    return rows.select("s1_entity_id", "target_entity_id", "source_id", "label", F.round(F.col("name_ratio").cast("double"), 5).alias("name_ratio"))


def unknown_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets per country where some are null or blank."""
    blank = F.when(F.col("pos") % 5 == 0, F.lit(None)).when(F.col("pos") % 7 == 0, F.lit("  ")).otherwise(F.col("country_norm"))
    every = catalog.entities(spark, sf_dir).withColumn("country_norm", blank.cast("string"))
    return candidates.index_stats(candidates.target_space((every, 2)))


def distinct_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = catalog.entities(spark, sf_dir)
    return profile.distinct_values(every.withColumn("country_norm", F.when(F.col("pos") % 5 > 0, F.col("country_norm"))), "country_norm")


def exploded_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed matches of anchors that have any, one a row."""
    return profile.link_pairs(catalog.normalized_truth(spark, sf_dir).where("not is_singleton"))


def decided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates at or over the default threshold, their score taken as a probability."""
    # A pair's rank depends on better ones alone, so lower scores need no ranking; the margin is wider than the rounding below.
    least = max(PREDICT.min_score, 100 * PREDICT.threshold - 0.001)
    pairs = search.ranked(*catalog.stored_sides(spark, sf_dir), PREDICT.with_(min_score=least))
    decided = pairs.withColumn("prob", F.round(F.col("blocking_score") / 100, 6)).where(F.col("prob") >= PREDICT.threshold)
    return decided.select("s1_entity_id", "target_entity_id", "prob")


def insertion_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each target: sources in turn, rows as they stand."""
    from pyspark.sql import Window

    _, t = catalog.anchors_and_targets(spark, sf_dir)
    return t.select("entity_id", "country_norm", (F.row_number().over(Window.partitionBy("country_norm").orderBy("source_id", "pos")) - 1).alias("place"))


def reduction_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, t = catalog.anchors_and_targets(spark, sf_dir)
    counts = (catalog._joined(spark, sf_dir).count(), a.count(), t.count())
    return spark.createDataFrame([(*counts, round(recall.reduction_ratio(*counts), 6))], "n_candidates bigint, n_anchors bigint, n_targets bigint, ratio double")


def first_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the first twenty true links that are not among five candidates."""
    ranked = search.ranked(*catalog.stored_sides(spark, sf_dir), PREDICT.with_(max_candidates=30))
    return recall.missed(catalog.true_links(spark, sf_dir), ranked, 5, shown=20)


NAMES = (
    io_entity_file, io_truth_file, io_row_limit, io_missing_inputs, io_parquet_replaced, io_parquet_report, io_pruned_scan, io_result_files,
    io_id_sets, io_match_targets, io_inventory, io_scan_heads, validate_files, grouped_folds, training_rows, unknown_countries,
    distinct_countries, exploded_links, decided_pairs, insertion_order, reduction_ratio, first_misses,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in NAMES}
