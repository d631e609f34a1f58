"""Command line: prepare, train, predict, validate, and run, which does these in turn.

Exit codes: 0 done (validate: no error found), 1 failed or errors found, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from weftlink.operators import model
from weftlink.operators.candidates import FIELDS, target_space
from weftlink.operators.validate import validate
from weftlink.plans.resolve import resolve, write_lists
from weftlink.plans.settings import PREDICT
from weftlink.sources import tables

log = logging.getLogger("weftlink")
#: The files of a split, by what they hold.
ENTITY_FILES = {"train": ("train_source1", "train_source2", "train_source3"), "test": ("test_source1", "test_source2", "test_source3")}
TRUTH_FILE = "train_ground_truth"


def prepare(spark: SparkSession, data_dir: str, output_dir: str, split: str = "all", limit: int | None = None) -> dict[str, dict]:
    """Normalised Parquet tables of the files that are there; a missing file is a warning. {table: report}"""
    reports = {}
    for part in ("train", "test") if split == "all" else (split,):
        for name in (*ENTITY_FILES[part], *((TRUTH_FILE,) if part == "train" else ())):
            path = f"{data_dir}/{part}/{name}.tsv"
            if not tables.exists(spark, path):
                log.warning("file not found, skipped: %s", path)
                continue
            if name == TRUTH_FILE:
                made = tables.normalise_truth(tables.read_truth(spark, path, limit))
            else:
                made = tables.normalise_entities(tables.read_entities(spark, path, limit), name.rsplit("_", 1)[1])
            reports[name] = tables.write_parquet(made, f"{output_dir}/{name}.parquet")
            log.info("%s: %s", name, reports[name])
    return reports


def _sides(spark: SparkSession, s1: str, s2: str, s3: str) -> tuple[DataFrame, DataFrame]:
    read = lambda path, n=None: tables.read_normalised(spark, path, ["entity_id", *FIELDS], n)
    return read(s1), target_space((read(s2, 2), 2), (read(s3, 3), 3))


def train(spark: SparkSession, s1: str, s2: str, s3: str, truth: str, output: str, sample_size: int = 100_000, folds: int = 4, trees: int = 350) -> tuple[float, float]:
    """Fit, tune and save; (threshold, macro F0.5)."""
    anchors, targets = _sides(spark, s1, s2, s3)
    rows, lists = model.training_set(anchors, targets, spark.read.parquet(truth), sample_size)
    fitted, threshold, score = model.train_and_tune(rows, lists, folds, trees)
    model.save(fitted, output, threshold, score)
    log.info("model at %s, threshold %.2f, F0.5 %.4f", output, threshold, score)
    return threshold, score


def predict(spark: SparkSession, model_path: str, s1: str, s2: str, s3: str, output_dir: str, threshold: float | None = None, max_candidates: int = 15, min_score: float = 35.0) -> None:
    """The two result files."""
    fitted, meta = model.load(model_path)
    anchors, targets = _sides(spark, s1, s2, s3)
    settings = PREDICT.with_(max_candidates=max_candidates, min_score=min_score)
    write_lists(resolve(anchors, targets, fitted, meta["best_threshold"] if threshold is None else threshold, settings), output_dir, single_file=True)


def check(spark: SparkSession, matching: str, candidate: str, test_dir: str, check_ids: bool = False, required: str | None = None) -> tuple[list[str], list[str]]:
    """(errors, warnings) of result files against the anchors of the test folder or of the file ``required``."""
    anchors = required or f"{test_dir}/test_source1.tsv"
    if not tables.exists(spark, anchors):
        return [f"file not found: {anchors}"], []
    targets = tables.read_match_targets(spark, test_dir) if check_ids else None
    errors, warnings = validate(spark, matching, candidate, tables.read_id_set(spark, anchors), targets)
    if check_ids and targets is None:
        warnings.append(f"ids are not checked: {test_dir} lacks a target file")
    return errors, warnings


def _say(errors: list[str], warnings: list[str]) -> int:
    for line in warnings:
        print(f"WARNING: {line}")
    for i, line in enumerate(errors, 1):
        print(f"  {i}. {line}")
    print(f"FAIL: {len(errors)} to mend" if errors else "PASS: nothing to mend")
    return 1 if errors else 0


def _parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="python -m weftlink", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    made = "data/processed"

    def command(name, help_, *arguments):
        own = commands.add_parser(name, help=help_)
        for flag, kind, default in arguments:
            own.add_argument(flag, **({"action": "store_true"} if kind is bool else {"choices": kind, "default": default} if isinstance(kind, tuple) else {"type": kind, "default": default}))
        return own

    raw = (("--data-dir", str, "dataset"), ("--output-dir", str, made), ("--split", ("train", "test", "all"), "all"), ("--limit", int, None))
    command("prepare", "normalise the tab-separated files", *raw)
    fit = (("--sample-size", int, 100_000), ("--folds", int, 4), ("--trees", int, 350))
    command("train", "fit and tune the model", *((f"--s{i}-path", str, f"{made}/train_source{i}.parquet") for i in (1, 2, 3)), ("--gt-path", str, f"{made}/{TRUTH_FILE}.parquet"), ("--output-model", str, "models/weftlink"), *fit)
    decide = (("--threshold", float, None), ("--max-candidates", int, 15), ("--min-score", float, 35.0))
    command("predict", "write the result files", ("--model-path", str, "models/weftlink"), *((f"--test-s{i}", str, f"{made}/test_source{i}.parquet") for i in (1, 2, 3)), ("--output-dir", str, "output"), *decide)
    command("validate", "check the result files", ("--matching", str, "output/matching_results.tsv"), ("--candidate", str, "output/candidate_pairs.tsv"), ("--test-dir", str, "dataset/test"), ("--check-ids", bool, False))
    command("run", "all of these in turn", ("--data-dir", str, "dataset"), ("--work-dir", str, "work"), ("--limit", int, None), *fit, *decide)
    return out


def run(spark: SparkSession, data_dir: str, work_dir: str, limit: int | None, sample_size: int, folds: int, trees: int, **decide) -> tuple[list[str], list[str]]:
    """Prepare, train, predict and check below ``work_dir``; ``data_dir`` may hold the dataset anywhere below it."""
    folder = tables.find_dataset(spark, data_dir, [f"{n}.tsv" for n in (*ENTITY_FILES["train"], TRUTH_FILE)])
    if folder is None:
        return [f"no training files below {data_dir}"], []
    data_dir = folder.rsplit("/", 1)[0]
    made, fitted = f"{work_dir}/processed", f"{work_dir}/model"
    prepare(spark, data_dir, made, limit=limit)
    train(spark, *(f"{made}/{n}.parquet" for n in (*ENTITY_FILES["train"], TRUTH_FILE)), fitted, sample_size, folds, trees)
    predict(spark, fitted, *(f"{made}/{n}.parquet" for n in ENTITY_FILES["test"]), work_dir, **decide)
    # A trial run on the first rows answers for these.
    required = f"{made}/test_source1.parquet" if limit else None
    return check(spark, f"{work_dir}/matching_results.tsv", f"{work_dir}/candidate_pairs.tsv", f"{data_dir}/test", required=required)


def main(argv: list[str] | None = None) -> int:
    args = vars(_parser().parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    spark = SparkSession.builder.appName("weftlink").getOrCreate()
    name = args.pop("command")
    try:
        if name == "prepare":
            return 0 if prepare(spark, args["data_dir"], args["output_dir"], args["split"], args["limit"]) else 1
        if name == "train":
            train(spark, args["s1_path"], args["s2_path"], args["s3_path"], args["gt_path"], args["output_model"], args["sample_size"], args["folds"], args["trees"])
            return 0
        if name == "predict":
            predict(spark, args["model_path"], args["test_s1"], args["test_s2"], args["test_s3"], args["output_dir"], args["threshold"], args["max_candidates"], args["min_score"])
            return 0
        if name == "validate":
            return _say(*check(spark, **args))
        return _say(*run(spark, **args))
    except (OSError, KeyError, ValueError, AnalysisException) as error:
        print(f"FAIL: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
