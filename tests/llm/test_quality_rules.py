import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docloom.llm import quality_rules as q
from tests.llm.data import documents, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def random_texts():
    rng = random.Random(7)
    out = []
    for i in range(150):
        words = [rng.choice("ab cd ef gh #x $% | ij klm".split()) for _ in range(rng.randrange(0, 120))]
        out.append((1000 + i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words), "en", "a", 1, None, None))
    return out


def test_statistics_equal_brute_force(spark):
    docs = documents(spark, random_texts())
    got = q.text_statistics(docs.withColumn("n", F.monotonically_increasing_id()), "text", ("n", "text")).collect()
    assert len(got) == docs.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.text


def test_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (50, 0, 0.05), (30, 29, 0.9)):
        assert math.isclose(q.binomial_tail(k, n, p), sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel_tol=1e-9)


def test_certified_cutoffs_hold_the_risk():
    counts = {rule: [0] * len(c) for rule, c in q.CANDIDATES.items()}
    counts["symbols"] = [0, 0, 0, 0, 3, 400, 500, 600, 700]
    found = q.certified(counts, 1000, 0.02, 0.001)
    assert found["symbols"] == q.CANDIDATES["symbols"][4]
    assert found["repeats"] == q.CANDIDATES["repeats"][-1]
    assert all(v is None for v in q.certified(counts, 100, 0.02, 0.001).values())


def corpus(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(1500):
        good = i % 3 > 0
        words = [f"w{rng.randrange(5000)}" + ("" if good else "###") for _ in range(80)]
        rows.append((i, " ".join(words), "en", "a", 1, None, None))
        labels.append((i, int(good)))
    labels += [(1, None), (None, 1), (9999, 1), (4, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, size bigint"), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_rejects_junk_and_keeps_good(spark):
    docs, labels = corpus(spark)
    kept = q.judge(docs, labels).join(labels.where("quality is not null"), "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    assert dict(kept.collect()) == {0: 0.0, 1: 1.0}
    ids = {r.doc_id for r in q.judge(docs, labels).where("kept").collect()}
    stay = q.keep_good(docs, labels)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} == ids


def test_edge_cases(spark):
    docs, labels = documents(spark), spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    got = q.judge(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.kept is not None and r.base_failed is not None for r in got)
    assert all(r.base_failed for r in got if r.doc_id in (3, 4, 5, 8))
    assert q.judge(empty(spark), labels).count() == 0
    assert q.keep_good(docs, labels.limit(0)).count() == sum(not r.base_failed for r in got)


def test_sql_where_cutoffs_bind(spark):
    """The query against its own SQL on the largest given table, where cutoffs are certified and reject documents."""
    import duckdb

    from docloom.llm import queries

    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    found = con.execute(queries.oracle_sql()["op7_quality_rules"])
    columns = [c[0] for c in found.description]
    want = sorted(tuple(r) for r in found.fetchall())
    assert sorted(tuple(r) for r in queries.op7_quality_rules(spark, sf).select(*columns).collect()) == want
    rows = [dict(zip(columns, r, strict=True)) for r in want]
    assert sum(not r["kept"] and not r["base_failed"] for r in rows) > 20
