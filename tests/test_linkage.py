"""Keys, candidates, features, metric, lists, model and checks."""

import math
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from weftlink.functions import similarity as sim
from weftlink.functions.keys import KeyRules, blocking_keys, without_legal_words
from weftlink.functions.lists import entity_f05, id_items, id_set
from weftlink.operators import candidates, evaluate, model, profile, recall, validate
from weftlink.operators.features import FEATURES, pair_features
from weftlink.plans import resolve
from weftlink.plans.settings import Settings
from weftlink.sources import tables
from weftlink.streaming import stream_entities, write_stream

RECORD = "entity_id string, name_norm string, clean_address string, city string, postal_code string, country_norm string"


def keys(spark, *record, rules=KeyRules()):
    df = spark.createDataFrame([("x", *record)], RECORD)
    return set(df.select(blocking_keys(*(F.col(c) for c in candidates.FIELDS), rules)).first()[0])


def test_keys(spark):
    got = keys(spark, "amazon web services inc", "410 terry ave n", "seattle", "98109", "united states")
    assert {"cn_p3:united states:ama", "cn_p4:united states:amaz", "post_p2:united states:98109:am", "city_p2:united states:seattle:am", "city_num:united states:seattle:410", "tok:united states:amazon", "tok:united states:web", "addr_tok:united states:terry"} <= got
    assert all(":united states:" in k for k in got) and "tok:united states:services" not in got
    assert {"cn_p3:us:bar", "cn_p3:us:the"} <= keys(spark, "the barn", "", None, None, "us")
    assert keys(spark, "राम मार्केटिंग", "", "pune", "411001", "india") == {"tok:india:राम", "tok:india:मार्केटिंग"}
    assert any(k.startswith("post_p2") for k in keys(spark, "राम मार्केटिंग", "", "pune", "411001", "india", rules=KeyRules(any_script=True)))
    assert keys(spark, "acme", "", None, None, "", rules=KeyRules(need_country=True)) == set()


def test_legal_words_go_to_a_fixpoint(spark):
    df = spark.createDataFrame([("acme private limited inc",), ("limited",), ("income trust corp",)], "v string")
    assert [r[0] for r in df.select(without_legal_words(F.col("v"))).collect()] == ["acme", "", "income"]


def slow_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_ratio(a, b):
    return 200 * slow_common(a, b) / (len(a) + len(b)) if a or b else 100.0


def slow_token_set(a, b):
    """All strings of shared and other words, spelled out."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    if x & y and (x <= y or y <= x):
        return 100.0
    shared = " ".join(sorted(x & y))
    own, other = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    with_own, with_other = f"{shared} {own}".strip(), f"{shared} {other}".strip()
    tries = [(with_own, with_other)] + ([(shared, with_own), (shared, with_other)] if shared else [])
    # The shared words stand first, so at least they and what the rests have in common are common.
    common = [(len(shared) + bool(shared) if shared else 0) + slow_common(own, other)] + [len(shared)] * 2
    return max(200 * c / (len(p) + len(q)) for (p, q), c in zip(tries, common, strict=False))


def test_similarities_match_brute_force():
    rng = random.Random(1)
    text = lambda most, letters="abc d": "".join(rng.choice(letters) for _ in range(rng.randrange(0, most)))
    pairs = [(text(14), text(14)) for _ in range(400)] + [(text(n, "abcdé \U0001f600"), text(n, "abcdé \U0001f600")) for n in (70, 130, 200) for _ in range(8)]
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    assert list(sim.common_lengths(a, b)) == [slow_common(x, y) for x, y in pairs]
    assert list(sim.ratios(a, b)) == pytest.approx([slow_ratio(x, y) for x, y in pairs])
    assert list(sim.token_sort_ratios(a, b)) == pytest.approx([slow_ratio(" ".join(sorted(x.split())), " ".join(sorted(y.split()))) for x, y in pairs])
    assert list(sim.token_set_ratios(a, b)) == pytest.approx([slow_token_set(x, y) for x, y in pairs])
    got = sim.partial_ratios(a, b)
    for (x, y), best in zip(pairs[:400], got, strict=False):
        windows = lambda s, t: max((slow_ratio(s, t[max(0, e - len(s)) : e]) for e in range(1, len(t) + len(s))), default=0.0)
        short, long = sorted((x, y), key=len)
        want = 100.0 if not long else 0.0 if not short else max(windows(x, y), windows(y, x)) if len(x) == len(y) else windows(short, long)
        assert best == pytest.approx(want), (x, y)
    assert sim.ratio("", "") == 100 and sim.ratio("a", "") == 0
    assert sim.token_sort_ratio("b a", "a b") == 100 and sim.token_set_ratio("a b c", "c a") == 100
    assert sim.token_set_ratio("", "a") == 0 and sim.token_set_ratio("x", "y") == 0
    assert sim.ratios([], []).size == 0 and sim.partial_ratios([], []).size == 0


def side(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def test_candidates(spark):
    a = side(spark, [("S1-1", "starbucks coffee", "pike place", "seattle", "98101", "us"), ("S1-2", "acme", "", None, None, "in"), ("S1-3", "lonely", "", None, None, "zz"), ("S1-4", "", "pike place", "seattle", None, "us")])
    t = side(spark, [("S2-1", "starbucks coffee company", "1912 pike place", "seattle", "98101", "us"), ("S2-2", "acme", "", None, None, "us")])
    t3 = side(spark, [("S3-1", "starbucks", "", None, None, "us")])
    space = candidates.target_space((t, 2), (t3, 3))
    got = candidates.candidate_pairs(a, space).collect()
    assert {(r.s1_entity_id, r.target_entity_id) for r in got} == {("S1-1", "S2-1"), ("S1-1", "S3-1")}
    best = next(r for r in got if r["rank"] == 1)
    assert best.target_entity_id == "S2-1" and best.blocking_score > 70
    lists = {r.source1_entity_id: r for r in resolve.resolve_by_score(a, space).collect()}
    assert set(lists) == {"S1-1", "S1-2", "S1-3", "S1-4"} and lists["S1-3"].candidate_entity_ids == ""
    assert lists["S1-1"].candidate_entity_ids == "S2-1,S3-1"


def test_cap_modes(spark):
    a = side(spark, [("S1-1", "zebra", "", None, None, "us")])
    t = candidates.target_space((side(spark, [(f"S2-{i:02}", "zebra", "", None, None, "us") for i in range(12)]), 2))
    n = lambda **k: candidates.shared_keys(a, t, Settings(**k)).count()
    assert n(cap=12, cap_take=3) == 12 and n(cap=11, cap_take=3) == 3
    assert n(cap=5, cap_mode="truncate") == 5 and n(cap=5, cap_mode="skip") == 0
    first = candidates.shared_keys(a, t, Settings(cap=5, cap_take=2)).collect()
    assert {r.target_entity_id for r in first} == {"S2-00", "S2-01"}


def test_plan_of_ranking_limits_groups_early(spark):
    a = side(spark, [("S1-1", "zebra", "", None, None, "us")])
    plan = candidates.candidate_pairs(a, candidates.target_space((a, 2)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "Cartesian" not in plan and "NestedLoop" not in plan


PAIR = "s1_entity_id string, target_entity_id string, source_id int, blocking_score double, " + ", ".join(f"{s}_{f} string" for s in ("s1", "target") for f in ("name", "address", "city", "postal", "country"))


def test_features(spark):
    same = ("acme tech", "1 main street", "pune", "400001", "india")
    rows = [
        ("S1-1", "S2-1", 2, 95.0, *same, *same),
        ("S1-2", "S3-1", 3, 60.0, "acme tech solutions", "1 main street", "pune", "400001", "india", "acme technologies corp", "2 main street", "mumbai", "400002", "india"),
        ("S1-3", "S2-2", None, None, *[None] * 10),
    ]
    got = {r.s1_entity_id: r for r in pair_features(spark.createDataFrame(rows, PAIR)).collect()}
    x = got["S1-1"]
    assert all(x[f] == 1.0 for f in ("name_ratio", "name_partial_ratio", "name_exact_match", "addr_ratio", "city_exact_match", "postal_exact_match", "exact_name_and_city", "country_is_in", "name_x_addr"))
    assert x.blocking_score == pytest.approx(0.95)
    y = got["S1-2"]
    assert (y.postal_p2_match, y.addr_digits_match, y.is_source3, y.postal_exact_match) == (1.0, 0.0, 1.0, 0.0)
    z = got["S1-3"]
    assert all(not math.isnan(z[f]) for f in FEATURES) and z.addr_digits_match == 0.5 and z.name_ratio == 0
    empty = pair_features(spark.createDataFrame([], PAIR))
    assert len(empty.columns) == 34 and empty.count() == 0 and dict(empty.dtypes)["name_ratio"] == "float"


LISTS = "source1_entity_id string, matched_entity_ids string"


def test_metric(spark):
    f = lambda t, p: spark.range(1).select(entity_f05(F.array(*map(F.lit, t)).cast("array<string>"), F.array(*map(F.lit, p)).cast("array<string>"))).first()[0]
    assert f(["a", "b"], ["a", "c"]) == pytest.approx(0.5) and f(["a", "b", "c", "d"], ["a", "b", "e"]) == pytest.approx(1.25 * 2 / (1 + 3))
    assert f([], []) == 1.0 and f([], ["a"]) == 0.0 and f(["a"], []) == 0.0 and f(["a"], ["b"]) == 0.0
    truth = spark.createDataFrame([("1", "a"), ("2", ""), ("3", "a, b,,a"), ("4", None)], LISTS)
    found = spark.createDataFrame([("1", "a"), ("3", "a"), ("9", "z")], LISTS)
    row = evaluate.report(evaluate.per_entity(truth, found)).first()
    assert row.macro_f05 == pytest.approx((1 + 1 + 1.25 / 1.5 + 1) / 4)
    assert (row.total_entities, row.singleton_count, row.total_tp, row.total_fp, row.total_fn) == (4, 2, 2, 0, 1)
    assert evaluate.macro_f05(evaluate.per_entity(truth.limit(0), found)).first()[0] == 0.0
    with pytest.raises(ValueError):
        evaluate.id_lists(truth, "nope", "matched_entity_ids", "x")
    with pytest.raises(TypeError):
        evaluate.id_lists(spark.range(1).select("id", F.lit(1.5).alias("x")), "id", "x", "y")
    r = truth.select(id_set(F.col("matched_entity_ids")).alias("s"), F.size(id_items(F.col("matched_entity_ids"))).alias("n")).collect()
    assert [(sorted(x.s), x.n) for x in r] == [(["a"], 1), ([], 0), (["a", "b"], 3), ([], 0)]


def test_sweep(spark):
    pairs = spark.createDataFrame([("1", 0.9, 1), ("1", 0.6, 0), ("2", 0.45, 0)], "id string, prob double, label int")
    sizes = spark.createDataFrame([("1", 1), ("2", 0), ("3", 2)], "id string, n_truth int")
    sweep = {r.threshold: r.macro_f05 for r in evaluate.threshold_sweep(pairs, sizes).collect()}
    assert sweep[0.4] == pytest.approx((1.25 / 2.25) / 3) and sweep[0.5] == pytest.approx((1.25 / 2.25 + 1) / 3) and sweep[0.9] == pytest.approx(2 / 3)
    assert evaluate.best_threshold(evaluate.threshold_sweep(pairs, sizes)) == (0.65, pytest.approx(2 / 3))


def test_tsv_and_files(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\r\nS1-1\t"open\tNA\tUS\n\nS1-2\tAcme Inc\nS1-3\ta\tb\tc\td\nS1-4\t\t\t\n', encoding="utf-8")
    rows = {r.entity_id: r for r in tables.read_entities(spark, str(p)).collect()}
    assert set(rows) == {"S1-1", "S1-2", "S1-4"} and rows["S1-1"].business_name == '"open' and rows["S1-1"].business_address == "NA"
    assert rows["S1-2"].country == "" and tables.read_entities(spark, str(p), 1).count() == 1
    with pytest.raises(FileNotFoundError):
        tables.read_entities(spark, str(tmp_path / "none.tsv"))
    with pytest.raises(KeyError):
        tables.read_truth(spark, str(p))
    made = tables.normalise_entities(tables.read_entities(spark, str(p)), "source1")
    assert len(made.columns) == 12
    for _ in range(2):
        got = tables.write_parquet(made, str(tmp_path / "n.parquet"))
        assert got["rows"] == 3 and got["mb"] > 0
    back = tables.read_normalised(spark, str(tmp_path / "n.parquet"), ["entity_id", *candidates.FIELDS], 2)
    assert back.select("source_id", "pos.row").distinct().count() == 3
    assert tables.read_id_set(spark, str(tmp_path / "n.parquet")).count() == 3 and tables.read_id_set(spark, str(p)).count() == 4
    assert tables.read_match_targets(spark, str(tmp_path)) is None
    assert tables.inventory(spark, str(tmp_path), "*.tsv").count() == 1
    lists = spark.createDataFrame([("S1-1", ""), ("S1-2", "S2-1,S3-2")], LISTS)
    tables.write_results(lists, str(tmp_path / "r"), True)
    part = next((tmp_path / "r").glob("part-*"))
    assert sorted(part.read_text().splitlines()) == ["S1-1\t", "S1-2\tS2-1,S3-2", "source1_entity_id\tmatched_entity_ids"]
    tables.zip_results({"matching_results.tsv": str(part)}, str(tmp_path / "z.zip"))
    assert zipfile.ZipFile(tmp_path / "z.zip").namelist() == ["matching_results.tsv"]
    query = write_stream(stream_entities(spark, str(tmp_path) + "/*.tsv", "source1"), str(tmp_path / "s"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "s")).exceptAll(made).count() == 0 and spark.read.parquet(str(tmp_path / "s")).count() == 3


def test_checks_of_files(spark, tmp_path):
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    good, cand = tmp_path / "m.tsv", tmp_path / "c.tsv"
    cand.write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nS1-2\t\n")
    assert validate.validate(spark, str(good), str(cand), need) == ([], [])
    good.write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1,S1-9,X\nS1-1\tS3-7\nno tab\nS1-8\tS2-2\n")
    errors, warnings = validate.validate(spark, str(good), str(cand), need, spark.createDataFrame([("S2-1",)], "id string"))
    said = " | ".join(errors)
    for what in ("several rows", "repeated id", "S1- ids", "wrong prefix", "missing anchors: 1 (S1-2)", "unexpected anchors: 1 (S1-8)", "unknown target ids: 2", "without a tab"):
        assert what in said, (what, said)
    assert len(warnings) == 1
    good.write_text("source1_entity_id,matched_entity_ids\n")
    assert "commas" in validate.validate(spark, str(good), str(cand), need)[0][0]
    assert validate.validate(spark, str(tmp_path / "x"), str(tmp_path / "y"), need)[1] and len(validate.validate(spark, str(tmp_path / "x"), str(tmp_path / "y"), need, candidates_needed=True)[0]) == 2


def test_model(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        hit = i % 3 == 0
        rows.append((f"S1-{i % 60}", f"S2-{i}", 2, int(hit), *[float(rng.random() * 0.4 + 0.6 * hit) for _ in FEATURES]))
    df = spark.createDataFrame(rows, "s1_entity_id string, target_entity_id string, source_id int, label int, " + ", ".join(f"{f} float" for f in FEATURES))
    lists = df.groupBy(F.col("s1_entity_id").alias("id")).agg(F.collect_set(F.when(F.col("label") == 1, F.col("target_entity_id"))).alias("truth"))
    fitted, threshold, score = model.train_and_tune(df, lists, folds=2, trees=5)
    assert 0.4 <= threshold <= 0.9 and score > 0.9
    model.save(fitted, str(tmp_path / "m"), None, score)
    again, meta = model.load(str(tmp_path / "m"))
    assert meta["best_threshold"] == 0.70 and meta["feature_names"] == list(FEATURES)
    a, b = (sorted(r.prob for r in model.predict(m, df).collect()) for m in (fitted, again))
    assert a == b
    folds = df.select("s1_entity_id", model.fold(F.col("s1_entity_id")).alias("f")).distinct()
    assert folds.groupBy("s1_entity_id").count().where("count > 1").count() == 0


def test_recall(spark):
    truth = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "s1_entity_id string, target_entity_id string")
    ranked = spark.createDataFrame([("1", "a", 1), ("1", "x", 2), ("1", "b", 7)], "s1_entity_id string, target_entity_id string, rank int")
    assert {r.k: r.n_covered for r in recall.recall_at(truth, ranked).collect()} == {5: 1, 10: 2, 15: 2, 20: 2, 25: 2, 30: 2}
    assert {(r[0], r[1], r[2]) for r in recall.missed(truth, ranked, 5).collect()} == {("1", "b", 6), ("2", "c", -1)}
    anchors = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "entity_id string")
    assert tuple(recall.candidate_counts(anchors, ranked).first()) == (0.75, 0, 3)
    assert recall.reduction_ratio(5, 10, 10) == 0.95 and recall.reduction_ratio(0, 0, 1) == 0.0


def test_missed_namesakes_are_made_last(spark, monkeypatch):
    """As ``missed`` of the joined pairs, also of ids with several names, and of blocks; nothing is shuffled once pairs are made, and one name's pairs fill no task alone."""
    rng = random.Random(8)
    some = lambda s, n: [(f"S{s}-{rng.randrange(n * 2 // 3)}", rng.choice(["a", "b", "c", "d", "", None] + ["hub"] * 6)) for _ in range(n)]
    a, t = (spark.createDataFrame(some(s, n), "entity_id string, name string") for s, n in ((1, 60), (2, 80)))
    truth = a.where("name <> ''").select(F.col("entity_id").alias("s1_entity_id"), "name").join(t.select(F.col("entity_id").alias("target_entity_id"), "name"), "name").select("s1_entity_id", "target_entity_id")
    pairs = truth.distinct().sort("s1_entity_id", "target_entity_id").collect()
    ranked = [(*p, rng.randrange(1, 30)) for p in rng.sample(pairs, len(pairs) // 3)] + [("S1-1", "S2-none", 1), ("S1-none", "S2-1", 9)] + [(*pairs[0], 7)]
    ranked = spark.createDataFrame(ranked, "s1_entity_id string, target_entity_id string, rank int")
    want = sorted(recall.missed(truth, ranked, 5).collect())
    for block in (3, 1024):
        monkeypatch.setattr(recall, "BLOCK", block)
        got = recall.missed_namesakes(a, t, ranked, 5)
        assert sorted(got.collect()) == want and any(r.rank > 0 for r in want) and any(r.rank < 0 for r in want)
        plan = got._jdf.queryExecution().sparkPlan().toString()
        assert "ShuffledHashJoin" in plan and not any(x in plan.partition("ShuffledHashJoin")[0] for x in ("Exchange", "Aggregate", "SortMergeJoin"))
    monkeypatch.setattr(recall, "BLOCK", 8)
    one = lambda s: spark.range(128).select(F.concat(F.lit(f"S{s}-"), F.col("id").cast("string")).alias("entity_id"), F.lit("hub").alias("name"))
    tasks = recall.missed_namesakes(one(1), one(2), ranked.limit(0), 5).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r[1] for r in tasks) == 128 * 128 and max(r[1] for r in tasks) < 128 * 128 // 2


def test_links_rank_alike_from_their_least_score_on(spark):
    """Ranks of records with one name do not change if lower scores, and anchors without such records, are left out."""
    from weftlink.operators import search

    rng = random.Random(9)
    names = ["acme tech", "acme tech lyon", "zebra", "été", ""]
    make = lambda s, n: side(spark, [(f"S{s}-{i:03}", rng.choice(names), rng.choice(["", "12 rue acme", "zebra lyon 44", "acme lyon"]), None, None, rng.choice(["fr", "us"])) for i in range(n)])
    a, t = make(1, 60), candidates.target_space((make(2, 60), 2), (make(3, 60), 3))
    named = lambda df, s: df.select(F.col("entity_id").alias(f"{s}_entity_id"), "name_norm")
    links = named(a, "s1").join(named(t, "target"), "name_norm").drop("name_norm")
    ranks = lambda r: sorted(r.join(links, links.columns).select(*links.columns, "rank").collect())
    settings = Settings(max_candidates=8)
    linked = a.join(t.where("name_norm <> ''").select("name_norm"), "name_norm", "left_semi")
    want = ranks(search.ranked(a, t, settings))
    assert ranks(search.ranked(linked, t, settings.with_(min_score=search.EQUAL_NAMES))) == want and {r.rank for r in want} == set(range(1, 9))


def test_samples(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("k"))
    a, b = (sorted(r[0] for r in profile.sample_rows(x, 7, "k").collect()) for x in (df, df.repartition(5)))
    assert a == b and len(a) == 7 and profile.sample_rows(df, 0, "k").count() == 50
    truth = spark.createDataFrame([("S1-1", "S2-1,S2-2"), ("S1-2", "")], LISTS)
    assert profile.sample_links(truth).count() == 1


def test_ranking_where_keys_meet_is_that_of_all_pairs(spark, monkeypatch):
    """Scores, ties and caps as the plain join has them, also of keys dealt over tasks, in few or many chunks; pairs with their texts are never shuffled."""
    from weftlink.operators import search

    rng = random.Random(5)
    word = lambda: rng.choice(["zebra", "acme", "tech", "rue", "été", "lyon", "12", "44", "x", ""])
    text = lambda n: " ".join(word() for _ in range(rng.randrange(0, n))).strip()
    make = lambda s, n: side(spark, [(f"S{s}-{i:03}", text(20 if i % 9 else 60), text(8 if i % 7 else 60), rng.choice(["lyon", None]), rng.choice(["69001", None]), rng.choice(["fr", "us", None])) for i in range(n)] + [(None, "zebra", "", None, None, "fr")])
    a, t = make(1, 60), candidates.target_space((make(2, 60), 2), (make(3, 60), 3))
    for settings in (Settings(max_candidates=3, min_score=0.0), Settings(cap=12, cap_take=4, min_score=60.0)):
        want = candidates.best(candidates.scored(candidates.shared_keys(a, t, settings), a, t, settings), settings)
        columns = ("s1_entity_id", "rank", "target_entity_id", "source_id", "pos", "blocking_score")
        want = sorted(want.select(*columns).collect())
        for deal, together in ((2, 5),):
            monkeypatch.setattr(search, "DEAL", deal)
            monkeypatch.setattr(search, "TOGETHER", together)
            assert sorted(search.ranked(a, t, settings).select(*columns).collect()) == want and want
    # Both sides' texts are on one row after the ranking alone.
    plan = candidates.candidate_pairs(a, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.index("row_number") < plan.index("MapInArrow")


def test_measures_of_prepared_texts_match():
    from weftlink.functions import bitpairs

    rng = random.Random(3)
    for most, letters in ((14, "abc d"), (70, "abcdé \U0001f600"), (150, "abcdefgh   "), (64, "ab c")):
        a, b = ([*("".join(rng.choice(letters) for _ in range(rng.randrange(0, most))) for _ in range(40)), "", "a b"] for _ in range(2))
        x, y = (i % len(a) for i in (sim.np.arange(len(a) ** 2), sim.np.arange(len(a) ** 2) // len(a)))
        made = bitpairs.Pairs(*bitpairs.prepare(a, b), x, y)
        for name in ("ratio", "token_sort_ratio", "token_set_ratio"):
            want = sim.MEASURES[name]([a[i] for i in x], [b[j] for j in y])
            assert (getattr(made, name)() == want).all(), (name, most)


def test_best_windows_match_brute_force():
    """Also of equal lengths, where windows of either text count, and of texts too long for small numbers."""
    from weftlink.functions import bitpairs, windows

    rng = random.Random(4)
    for most, letters, many in ((7, "ab", 40), (14, "abc d", 25), (70, "abcdé \U0001f600", 8), (330, "abcd  ", 3)):
        a, b = ([*("".join(rng.choice(letters) for _ in range(rng.randrange(0, most))) for _ in range(many)), "", "abab"] for _ in range(2))
        x, y = sim.np.arange(len(a) ** 2) % len(a), sim.np.arange(len(a) ** 2) // len(a)
        left, right, _ = bitpairs.prepare(a, b)
        best, common = windows.best_windows(left.forms["plain"], left.length, right.forms["plain"], right.length, x, y)
        texts = [a[i] for i in x], [b[j] for j in y]
        assert (best == sim.partial_ratios(*texts)).all() and (common == sim.common_lengths(*texts)).all()


def test_measures_where_keys_meet_are_those_of_all_pairs(spark, monkeypatch):
    """Every pair that shares a key or is equal in a column comes once, with its measures, also of dealt keys; neither pairs nor their names are shuffled."""
    from weftlink.operators import search

    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice(["zebra", "acme", "tech", "rue", "été", "12", "x", ""]) for _ in range(rng.randrange(0, n))).strip()
    make = lambda s, n: side(spark, [(f"S{s}-{i:03}", text(12), text(6), rng.choice(["lyon", None]), None, rng.choice(["fr", "us", None])) for i in range(n)]).withColumn("raw", F.when(F.col("entity_id").endswith("7"), "").otherwise(F.substring("name_norm", 1, 4)))
    settings = Settings(cap=12, cap_take=4)
    a, t = make(1, 60), make(2, 60).withColumns({"source_id": F.lit(2), "pos": F.col("entity_id")})
    equal = a.where("raw <> ''").select(F.col("entity_id").alias("s1_entity_id"), "raw").join(t.select(F.col("entity_id").alias("target_entity_id"), "raw"), "raw")
    pairs = candidates.shared_keys(a, t, settings).select("s1_entity_id", "target_entity_id")
    both = pairs.union(equal.select(*pairs.columns)).distinct()
    assert both.count() > pairs.count() > 0
    names = {r.entity_id: r.name_norm for r in a.union(t.select(*a.columns)).collect()}
    rows = [tuple(r) for r in both.collect()]
    made = [sim.MEASURES[m]([names[x] for x, _ in rows], [names[y] for _, y in rows]) for m in search.NAME_MEASURES]
    want = spark.createDataFrame([(x, y, *(float(v[i]) for v in made)) for i, (x, y) in enumerate(rows)], "x string, y string, a double, b double, c double, d double")
    want = sorted(map(tuple, want.select("x", "y", *(F.round(c, 6) for c in "abcd")).collect()))
    for deal, returned in ((search.DEAL, search.RETURNED), (2, 5)):
        monkeypatch.setattr(search, "DEAL", deal)
        monkeypatch.setattr(search, "RETURNED", returned)
        found = search.measured(a, t, settings, "raw")
        assert sorted(map(tuple, found.collect())) == want
    # The pairs are made in the last step.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow") and "ArrowEvalPython" not in plan


def test_rounding_is_that_of_sql(spark):
    from weftlink.operators import search

    values = [200 * c / n for n in (3, 7, 128, 1024, 2048, 5120) for c in range(0, n, max(1, n // 40))] + [0.0, 100.0]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert search._rounded(sim.np.array(values), 6).tolist() == want
