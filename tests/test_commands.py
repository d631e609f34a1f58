"""The command line and the SQL functions."""

import random

import pytest
from pyspark.sql import functions as F

from weftlink import __main__ as cli
from weftlink.functions import keys, lists, sql, text
from weftlink.operators.candidates import scored, shared_keys, target_space
from weftlink.sources import tables

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry"
PLACES = ("Lisbon", "Porto", "Braga", "Faro")


def dataset(root, n=60):
    """Three sources, the second and third with noisy copies of the first, in both splits."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3))
    for split in ("train", "test"):
        folder = root / "given" / split
        folder.mkdir(parents=True)
        out, truth = {1: [], 2: [], 3: []}, []
        for i in range(n):
            name, street, place = f"{word()} {word()}", f"{rng.randrange(1, 99)} {word()} St", rng.choice(PLACES)
            out[1].append(f"S1-{i}\t{name} Ltd\t{street}, {place}, XY\tPT")
            found = [s for s in (2, 3) if rng.random() < 0.6]
            for s in (2, 3):
                own = name.replace("a", "e", 1) if s in found else f"{word()} {word()}"
                out[s].append(f"S{s}-{i}\t{own} Limited\t{street if s in found else word()}, {place}, XY\tPT")
            truth.append(f"S1-{i}\t{','.join(f'S{s}-{i}' for s in found)}")
        for s, rows in out.items():
            (folder / f"{split}_source{s}.tsv").write_text("\n".join([HEAD, *rows]) + "\n")
        if split == "train":
            (folder / "train_ground_truth.tsv").write_text("\n".join(["source1_entity_id\tmatched_entity_ids", *truth]) + "\n")
    return root


def test_commands(spark, tmp_path, capsys):
    root, work = dataset(tmp_path), tmp_path / "work"
    assert tables.find_dataset(spark, str(root), ["test_source1.tsv"]).endswith("/given/test") and tables.find_dataset(spark, str(root), ["none"]) is None
    assert cli.main(["run", "--data-dir", str(root), "--work-dir", str(work), "--folds", "2", "--trees", "3"]) == 0
    assert "PASS" in capsys.readouterr().out
    rows = {r.id: r.ids for r in tables.read_id_lists(spark, str(work / "matching_results.tsv")).collect()}
    assert len(rows) == 60 and sum(f"S2-{i[3:]}" in ids or f"S3-{i[3:]}" in ids for i, ids in rows.items()) > 20
    check = ["validate", "--matching", str(work / "matching_results.tsv"), "--candidate", str(work / "candidate_pairs.tsv"), "--test-dir", str(root / "given/test")]
    assert cli.main([*check, "--check-ids"]) == 0
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tX-1\n")
    check[2] = str(tmp_path / "bad.tsv")
    assert cli.main(check) == 1 and "wrong prefix" in capsys.readouterr().out
    assert cli.main([*check[:-1], str(tmp_path)]) == 1


def test_prepare_skips_what_is_missing(spark, tmp_path, caplog):
    root = dataset(tmp_path)
    (root / "given/train/train_source2.tsv").unlink()
    prepare = ["prepare", "--data-dir", str(root / "given"), "--output-dir", str(tmp_path / "out"), "--split", "train", "--limit", "5"]
    assert cli.main(prepare) == 0 and "train_source2" in caplog.text
    assert spark.read.parquet(str(tmp_path / "out/train_source1.parquet")).count() == 5 and not (tmp_path / "out/train_source2.parquet").exists()
    assert cli.main(["prepare", "--data-dir", str(tmp_path / "nowhere"), "--output-dir", str(tmp_path / "out")]) == 1
    assert cli.main(["predict", "--model-path", str(tmp_path / "none"), "--test-s1", str(tmp_path / "none")]) == 1
    with pytest.raises(SystemExit) as wrong:
        cli.main(["nonsense"])
    assert wrong.value.code == 2


def test_lost_writer_leaves_a_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    df = tables.normalise_entities(spark.createDataFrame([("S1-1", "a", "b", "c")], ", ".join(f"{c} string" for c in tables.ENTITY)), "source1")
    tables.write_parquet(df, path)
    (tmp_path / "t.parquet").rename(tmp_path / "t.parquet.before")  # as if lost between its two renames
    assert tables.read_normalised(spark, path).count() == 1
    tables.write_parquet(df.union(df), path)
    assert tables.read_normalised(spark, path).count() == 2 and not (tmp_path / "t.parquet.before").exists()


def test_sql_functions_equal_the_columns(spark):
    names = sql.register(spark)
    assert {"normalise_name", "blocking_keys", "blocking_score", "token_set_ratio"} <= set(names)
    rows = [("Zed & Sons Corp", "The Old Mill, 7 Oak Rd, Lyon, FR 69001", "lyon", "69001", "fr"), ("m/s Quill Pvt Ltd", "Near City Bank, Agra", None, None, None), (None, "", "", "", "")]
    df = spark.createDataFrame(rows, "name string, address string, city string, postal string, country string")
    df.createOrReplaceTempView("given")
    c = F.col
    pairs = {
        "normalise_name(name)": text.name(c("name")),
        "normalise_country(country)": text.country(c("country")),
        "normalise_address(address)": text.address(c("address")),
        "name_without_legal_words(name)": keys.without_legal_words(c("name")),
        "name_without_honorific(name)": keys.without_honorific(c("name")),
        "blocking_keys(name, address, city, postal, country)": keys.blocking_keys(c("name"), c("address"), c("city"), c("postal"), c("country")),
        "id_set(address)": lists.id_set(c("address")),
        "digit_runs(address)": lists.digit_runs(c("address")),
        "entity_f05(id_set(address), id_set(city))": lists.entity_f05(lists.id_set(c("address")), lists.id_set(c("city"))),
        "token_jaccard(name, address)": lists.jaccard(text.tokens(c("name")), text.tokens(c("address"))),
    }
    for call, column in pairs.items():
        made = spark.sql(f"select {call} as v from given")
        assert sorted(map(str, made.collect())) == sorted(map(str, df.select(column.alias("v")).collect())), call
        assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    record = "entity_id string, name_norm string, clean_address string, city string, postal_code string, country_norm string"
    a = spark.createDataFrame([("S1-1", "blue heron books", "4 quay street", "cork", None, "ie"), ("S1-2", "blue heron", "", "cork", None, "ie")], record)
    t = target_space((spark.createDataFrame([("S2-1", "blue heron book shop", "quay street 4", "cork", None, "ie"), ("S2-2", "blue ferry", "", "cork", None, "ie")], record), 2))
    scored(shared_keys(a, t), a, t).createOrReplaceTempView("met")
    got = spark.sql("select blocking_score as x, blocking_score(s1_name, target_name, s1_address, target_address) as y from met").collect()
    assert len(got) == 4 and all(r.x == pytest.approx(r.y) for r in got)
