from docloom.plans import driver


def test_unmatched_texts_compares_whole_texts(spark, tmp_path):
    long = "filler " * 100
    rows = [
        (1, 0, "user", "late words"), (1, 1, "assistant", long + "Late Words"),
        (2, 0, "user", "the same start, another end"), (2, 1, "assistant", "the same start, one end"),
        (3, 0, "user", " " + long + "quoted answer "), (3, 1, "assistant", "Quoted answer"),
        (4, 0, "user", None), (4, 1, "assistant", "x"), (5, 0, "user", "alone"), (6, 0, "user", "y"), (6, 1, "assistant", None),
    ]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    low = lambda t: t.strip(" ").lower()
    want = []
    for c, turn, role, t in rows:
        others = [low(o) for k, _, r, o in rows if k == c and r == "assistant" and o is not None]
        if role == "user" and not (t is not None and any(low(t) in o or o in low(t) for o in others)):
            want.append((c, turn))
    assert sorted(map(tuple, driver.unmatched_texts(spark, str(tmp_path)).collect())) == want == [(2, 0), (4, 0), (5, 0), (6, 0)]


def test_purge_duplicates_reads_all_lines(spark, tmp_path):
    tables = {
        "documents": ([(1, 10), (2, 10), (3, 11)], "doc_id bigint, n_chars bigint"),
        "lineitem": ([(1, 1, 5), (1, 2, 7), (2, 1, 6), (2, 2, 7)], "l_orderkey bigint, l_linenumber bigint, l_partkey bigint"),
        "orders": ([(1, 7), (2, 8), (3, 10)], "o_orderkey bigint, o_custkey bigint"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found: dict[str, list[int]] = {}
    for r in driver.purge_duplicates(spark, str(tmp_path)).collect():
        found.setdefault(r.name, [0, 0])[0 if r.clean else 1] += r.n
    assert found == {"case_texts": [1, 2], "test": [2, 2], "other": [1, 2]}


def test_split_first_is_exact_and_keeps_equal_rows(spark):
    from docloom.operators import datasets

    rows = [("hot", 0)] * 500 + [(f"t{i}", i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "text string, label int")
    every = sorted(rows)
    previous: set[tuple] = set()
    for n in (-1, 0, 1, 250, 600, 900, 1000):
        first, rest = datasets.split_first(df.repartition(7), n)
        a, b = ([tuple(r) for r in x.collect()] for x in (first, rest))
        assert len(a) == min(max(n, 0), 900) and sorted(a + b) == every
        assert previous <= set(a)
        previous = set(a)
