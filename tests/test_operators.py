import math

import pytest
from pyspark.sql import functions as F

from docloom.operators import aggregates, datasets, dedup, enrich, evaluate, keys


def test_ids(spark):
    df = spark.createDataFrame([("12",), ("12.9",), ("abc",), (None,), ("-3.5",), ("NaN",), ("",)], "c string")
    rows = df.select(keys.safe_id(F.col("c")).alias("a"), keys.lenient_id(F.col("c")).alias("b"), keys.to_number(F.col("c")).alias("n")).collect()
    assert [r.a for r in rows] == [12, 12, -999, -1, -3, -999, -999]
    assert [r.b for r in rows] == [12, 12, -1, -1, -3, -1, -1]
    assert rows[0].n == 12.0 and rows[2].n is None


def table(spark, ids, **more):
    return spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "id bigint, t string")


def test_purge_is_complementary_and_idempotent(spark):
    tables = {"case_texts": table(spark, [1, 1, 2, 3, -1, -1, None, None]), "test": table(spark, [2, 2, 4]), "train": table(spark, [1, 2, 3, 4, -1, None])}
    clean, unused = dedup.purge(tables, "id")
    ids = lambda df: sorted([r.id for r in df.collect()], key=str)
    # the texts lose their own duplicates only; bad ids and nulls are no duplicates
    assert ids(clean["case_texts"]) == [-1, -1, 2, 3, None, None] and ids(unused["case_texts"]) == [1, 1]
    assert ids(clean["train"]) == [-1, 3, 4, None] and ids(unused["train"]) == [1, 2]
    assert ids(clean["test"]) == [4]
    again, gone = dedup.purge(clean, "id")
    assert all(again[n].count() == clean[n].count() and gone[n].count() == 0 for n in tables)
    loose, _ = dedup.purge(tables, "id", strict=False)
    assert ids(loose["train"]) == [3, 4, None]


def test_first_rows(spark):
    df = spark.createDataFrame([(1, "B ", 2), (1, "b", 1), (2, "c", 3)], "k bigint, t string, o bigint")
    assert sorted((r.k, r.o) for r in dedup.first_by(df, ["k"], [F.col("o")]).collect()) == [(1, 1), (2, 3)]
    assert sorted(r.o for r in dedup.first_text(df, "t", [F.col("o")]).collect()) == [1, 3]


def test_sets(spark):
    a, b = table(spark, [1, 2, 2, None]), table(spark, [2, 3])
    assert [r.id for r in dedup.common_keys(a, b, "id").collect()] == [2]
    assert {r.id for r in dedup.missing_keys(a, b, "id").collect()} == {1, None}
    assert {(r.id, r.side) for r in dedup.vocabulary(a.na.drop(), b, "id").collect()} == {(1, "only_a"), (2, "both"), (3, "only_b")}
    x = spark.createDataFrame([("a", None), ("a", 1), ("b", None)], "t string, l int")
    assert dedup.without_values(x, x.limit(1), ["t", "l"]).count() == 2


def test_enrichment_keeps_the_rows(spark):
    base = spark.createDataFrame([(1, "x"), (2, "y"), (3, None), (3, None)], "decisionID bigint, decision_outcome string")
    texts = spark.createDataFrame([(1, "one"), (1, "two")], "decisionID bigint, full_text string")
    labels = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (2, None, 1)], "decisionID bigint, extracted_sentences_determination string, ord bigint")
    entities = spark.createDataFrame([(1, "e", 5)], "decisionID bigint, decision_outcome string, n bigint")
    sentences = spark.createDataFrame([(1, "s2", 2), (1, "s1", 1), (1, None, 3)], "decisionID bigint, Text string, sentence_order bigint")
    got = {r.decisionID: r for r in enrich.enrich(base, texts, labels, entities, sentences).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[1].full_text == "one" and got[1].extracted_sentences_determination == ["a", "b"] and got[1].determination_count == 2
    assert got[1].sentence_text == "s1 s2 " and got[1].decision_outcome == "x" and got[1].decision_outcome_estimated == "e"
    assert got[2].extracted_sentences_determination == [None] and got[3].determination_count == 0 and got[3].extracted_sentences_determination == []


def test_unmatched(spark):
    e = spark.createDataFrame([(1, "The Claim"), (1, "other"), (2, "x")], "id bigint, text string")
    f = spark.createDataFrame([(1, "so the claim is"), (1, None)], "id bigint, text string")
    assert sorted((r.id, r.text) for r in enrich.unmatched(e, f, "id", "text").collect()) == [(1, "other"), (2, "x")]


def test_statistics(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("x"), F.lit("g").alias("g"), (F.col("id") % 2).alias("z"))
    assert aggregates.axis_maximum(df, ["x"]).first()[0] == 100.0
    assert aggregates.axis_maximum(df.select((F.col("x") * 2).alias("x")), ["x"]).first()[0] == 200.0
    assert dict(aggregates.histogram(df, "x", 10, 100).collect()) == {0: 9} | {i: 10 for i in range(1, 9)} | {9: 11}
    d = aggregates.describe(df, ["g"], "x", "z").first()
    assert (d.n, d.mean, d.median) == (100, 50.5, 50.5) and math.isclose(d.std, 29.011491975882016) and d.mean_ratio == 50.0
    out = aggregates.outliers(df.unionByName(spark.createDataFrame([(900.0, "g", 1), (800.0, "g", 1)], df.schema)), "g", "x", "z")
    assert [r.x for r in out.orderBy("rank").collect()] == [900.0, 800.0]
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "r string, c string")
    assert {(r.r, r.c, r.margin): r["count"] for r in aggregates.crosstab(rows, "r", "c").collect()}[None, None, 3] == 3
    assert {r.r: r.weight for r in aggregates.class_weights(rows, "r").collect()} == {"a": 0.75, "b": 1.5}
    assert [(r.r, r["count"]) for r in aggregates.top_values(rows.withColumn("o", F.lit(1)), "r", "o", 1).collect()] == [("a", 2)]
    s = aggregates.validation_summary(rows, rows.limit(0), "r").first()
    assert (s.before_rows, s.before_ids, s.after_rows, s.reduction) == (3, 2, 0, 100.0)
    assert aggregates.validation_summary(rows.limit(0), rows.limit(0), "r").first().reduction == 0.0
    assert [r.samples for r in aggregates.column_profile(spark.createDataFrame([(None, 1)], "a string, b int")).orderBy("position").collect()] == [["NaN"], ["1"]]
    assert tuple(aggregates.presence(rows, ["r"]).first()) == (3, 3)
    assert aggregates.length_statistics(rows, "r").first().most == 1


def test_case_metrics(spark):
    cases = spark.createDataFrame([(1, 4), (2, 0), (3, 2), (4, None)], "id bigint, determination_count bigint")
    found = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "id bigint, text string")
    m = evaluate.case_metrics(cases, found, "id")
    assert {r.id: (r.extracted_count, r.expected_count, r.count_ratio) for r in m.collect()} == {1: (1, 4, 0.25), 2: (1, 0, 1.0), 3: (2, 2, 1.0), 4: (0, 0, 0.0)}
    s = evaluate.case_summary(m).first()
    assert (s.cases_meeting_expected, s.total_cases, s.pct_meeting_expected, s.avg_count_ratio) == (2, 4, 0.5, 0.5625)
    assert evaluate.case_summary(m.limit(0)).first().total_cases == 0
    expected = spark.createDataFrame([(1, "A"), (1, "zz"), (1, None)], "id bigint, text string")
    texts = spark.createDataFrame([(1, "x" * 3000)], "id bigint, full_text string")
    r = evaluate.under_extracted(m, expected, found, texts, "id").collect()
    assert [(x.id, x.gap, x.missing, len(x.case_text)) for x in r] == [(1, 3, ["zz"], 2003)]
    many = spark.createDataFrame([(3, f"n{i}") for i in range(5)], "id bigint, text string")
    o = evaluate.over_extracted(evaluate.case_metrics(cases, many, "id"), spark.createDataFrame([(3, "n0")], "id bigint, text string"), many, texts, "id").collect()
    assert [(x.id, x.gap, x.extra) for x in o] == [(3, 3, ["n1", "n2", "n3", "n4"])]


def test_sweep_equals_confusion_at_each_threshold(spark):
    import random

    rng = random.Random(2)
    data = [(rng.randrange(2), round(rng.random(), 2)) for _ in range(300)]
    df = spark.createDataFrame(data, "label int, prob double")
    got = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in evaluate.sweep(df, evaluate.SWEEP).collect()}
    for t in evaluate.SWEEP:
        c = [sum(1 for y, p in data if (p > t) == hit and y == label) for hit, label in ((True, 1), (True, 0), (False, 1), (False, 0))]
        assert got[t] == tuple(c)


def test_ties_take_the_lowest_threshold(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, prob double")
    assert evaluate.best_threshold(evaluate.sweep(df, evaluate.SWEEP), "f1").first().threshold == 0.2
    assert evaluate.best_threshold(evaluate.sweep(df, evaluate.SWEEP), "recall", 1.1).count() == 0


def votes(spark):
    rows = [(1, m, p, float(p), 1) for m, p in (("a", 1), ("b", 1), ("c", 0))] + [(2, m, 1, 1.0, 1) for m in "abc"] + [(3, m, p, float(p), 0) for m, p in (("a", 1), ("b", 0), ("c", 0))]
    return spark.createDataFrame(rows, "id bigint, model string, pred int, prob double, label int")


def test_votes(spark):
    v = votes(spark)
    # two thirds is below 0.667
    assert {r.id: r.pred for r in evaluate.majority(v, "id").collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.threshold: r.tp for r in evaluate.vote_sweep(v, "id").collect()} == {0.5: 2, 0.6: 2, 0.667: 1, 0.75: 1}
    overlap = {(r.m1, r.m2): (r.both, r.only1, r.only2, r.total1, r.total2) for r in evaluate.error_overlap(v, "id").collect()}
    assert overlap == {("a", "b"): (0, 1, 0, 1, 0), ("a", "c"): (0, 1, 1, 1, 1), ("b", "c"): (0, 0, 1, 0, 1)}
    wide = {r.id: r for r in evaluate.wide_votes(v, "id", ["a", "b", "c"]).collect()}
    assert wide[1].c_error and not wide[1].a_error and wide[3].errors == 1
    assert {r.id: r.status for r in evaluate.agreement(evaluate.wide_votes(v, "id", ["a", "c"]), "a_pred", "c_pred").collect()} == {1: "only_a_pred", 2: "both_correct", 3: "only_c_pred"}
    assert sorted((r.id, r.error_type) for r in evaluate.mispredictions(v).collect()) == [(1, "FN"), (3, "FP")]
    e = evaluate.error_shares(v).first()
    assert (e.fp, e.fn) == (1, 1) and math.isclose(e.fp_pct, 100 / 9)
    assert evaluate.rounded(evaluate.confusion(v.limit(0), [])).first().f1 == 0.0


def test_silver(spark):
    ext = "array<struct<text:string,score:double>>"
    docs = spark.createDataFrame(
        [(1, [("The appeal is dismissed", 1.0), ("THE APPEAL IS DISMISSED", 1.0), ("[1]", 1.0)], [("He finds that it is so", 1.0), ("No word here", 1.0)]), (2, [("x" * 300, 1.0)], None)],
        f"id bigint, sparse_explicit_extraction {ext}, reasons_basic_extraction {ext}",
    )
    judged = datasets.silver_positives(datasets.silver_candidates(docs, "id", ("sparse_explicit_extraction", "absent", "reasons_basic_extraction")), "id")
    assert sorted(r.status for r in judged.collect()) == ["accepted", "accepted", "duplicate", "empty", "no_keyword", "too_long"]
    assert {r.text for r in datasets.silver_set(judged).collect()} == {"The appeal is dismissed.", "He finds that it is so."}
    assert {r.column: r.accepted for r in datasets.silver_statistics(judged).collect()} == {"sparse_explicit_extraction": 1, "reasons_basic_extraction": 1}


def test_train_test(spark):
    rows = [(f"one {i}", 1) for i in range(20)] + [(f"two {i}", 2) for i in range(50)] + [(f"zero {i}", 0) for i in range(200)]
    a = spark.createDataFrame(rows, "text string, label int")
    s = spark.createDataFrame([("silver", 1)], "text string, label int")
    train, test = datasets.train_test(a, s)
    n = lambda df: {r.label: r["count"] for r in df.groupBy("label").count().collect()}
    # 20 ones, 5 of the twos and 15 zeros balance the test set
    assert n(test) == {1: 20, 0: 20} and n(train) == {0: 45 + 185, 1: 1}
    assert not {r.text for r in train.collect()} & {r.text for r in test.collect()}
    again = datasets.train_test(a.repartition(7), s)[1]
    assert {r.text for r in again.collect()} == {r.text for r in test.collect()}
    x, y = datasets.random_split(a, "text")
    assert x.count() + y.count() == 270 and 200 < x.count() < 260
    assert [r.n_words for r in datasets.by_length(spark.createDataFrame([("a b",), ("a",)], "t string"), "t").collect()] == [1, 2]


def test_small_tools(spark):
    df = spark.createDataFrame([(1, [("a", 5.0), ("b", 1.0)])], "id bigint, x array<struct<t:string,score:double>>")
    assert [r.t for r in df.select(keys.keep_scored(F.col("x"), 2.0).alias("r")).first().r] == ["a"]
    assert keys.present(df, ["id", "none"]).columns == ["id"]
    with pytest.raises(ValueError, match="none"):
        keys.require(df, ["id", "none"])
    assert keys.sample(spark.range(100), "id", 5).collect() == keys.sample(spark.range(100).repartition(3), "id", 5).collect()
