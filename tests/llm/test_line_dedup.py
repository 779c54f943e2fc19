from collections import Counter

from pyspark.sql import functions as F

from docloom.llm import line_dedup
from tests.llm.data import documents, empty

STRIP = " \t\r\x0b\f"


def brute(rows, ratio, least):
    total = Counter(r.source for r in rows)
    pages = Counter()
    for r in rows:
        for line in {x.strip(STRIP) for x in (r.text or "").split("\n")} - {""}:
            pages[r.source, line] += 1
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for r in rows:
        if r.text is None:
            out.append((r.doc_id, None, 0, 0))
            continue
        lines = r.text.split("\n")
        kept = [x for x in lines if (r.source, x.strip(STRIP)) not in bad]
        out.append((r.doc_id, "\n".join(kept), sum(x.strip(STRIP) != "" for x in lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def sites(spark):
    rows = [(100 + i, f"Menu \nown line {i}\n\n menu of site\nMenu", "en", f"s{i % 2}", 1, None, None) for i in range(20)]
    rows += [(200 + i, f"menu of site\nother {i}", "en", None, 1, None, None) for i in range(6)]
    return documents(spark, rows)


def test_equals_brute_force_on_both_ways(spark):
    docs = sites(spark)
    want = brute(docs.collect(), 0.3, 3)
    for limit in (1000, 0):
        got = line_dedup.drop_boilerplate(docs, "source", "text", 0.3, 3, broadcast_rows=limit)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert sorted([(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()], key=str) == want
    assert any(x[3] for x in want)


def test_empty_table(spark):
    assert line_dedup.drop_boilerplate(empty(spark), "source", "text").count() == 0


def test_no_python_in_the_plan(spark):
    out = line_dedup.drop_boilerplate(sites(spark).select("doc_id", "text", "source"), "source", "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_long_single_line(spark):
    docs = spark.range(8).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x y "), 100_000).alias("text"), F.lit("s").alias("source"))
    assert line_dedup.drop_boilerplate(docs, "source", "text").agg(F.sum("n_dropped")).first()[0] == 8
