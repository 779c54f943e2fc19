import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import sections as S
from tests.header_scan import find_headers

BODY = "intro\n\n{}\n\nbody text that is long enough here\n\nmore body text in lines"
EXPECTED = [
    ("DECISION", ("decision", "DECISION"), ("decision", "DECISION")),
    ("REASONS FOR DECISION", ("reasons", "REASONS FOR DECISION"), ("decision", "DECISION")),
    ("THE DECISION", ("decision", "THE DECISION"), ("decision", "DECISION")),
    ("8 CONCLUSION", ("conclusion", "CONCLUSION"), ("conclusion", "CONCLUSION")),
    ("CONCLUSION [18]", ("conclusion", "CONCLUSION"), ("conclusion", "CONCLUSION")),
    ("CONCLUSION:", ("conclusion", "CONCLUSION"), ("conclusion", "CONCLUSION")),
    ("She returns to Tunisia. DECISION", ("decision", "DECISION"), ("decision", "DECISION")),
    ("He was refused. Analysis of risk follows", ("analysis", "ANALYSIS"), ("analysis", "ANALYSIS")),
    ("Decision makers must act", ("decision", "DECISION"), ("decision", "DECISION")),
    ("we now set out the decision", ("decision", "DECISION"), ("decision", "DECISION")),
    ("ANALYSIS", ("analysis", "ANALYSIS"), ("analysis", "ANALYSIS")),
    ("FINDINGS", None, None),
    ("D E C I S I O N", None, None),
]


def test_header_lines(spark):
    cases = [(text, want) for line, mid, last in EXPECTED for text, want in ((BODY.format(line), mid), (f"a\n\n{line}", last))]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    for r in df.select("i", S.headers(F.col("t")).alias("h")).collect():
        want = cases[r.i][1]
        assert [(h.category.removesuffix("_headers"), h.term) for h in r.h] == ([want] if want else [])


def test_strict_pack_takes_whole_lines_only(spark):
    strict = replace(R.LEGAL_HEADERS, strict=True)
    df = spark.createDataFrame([(0, "Decision makers must act"), (1, "The Decision:"), (2, "8 CONCLUSION [18]")], "i int, t string")
    got = [r.c and tuple(r.c) for r in df.select("i", S.classify(F.col("t"), strict).alias("c")).orderBy("i").collect()]
    assert got == [None, ("decision_headers", "DECISION"), ("conclusion_headers", "CONCLUSION")]


def random_texts(n=400):
    """Lines of header words, glue and short continuations, in every order that a scan could trip over."""
    rng = random.Random(11)
    terms = [t for _, of in R.LEGAL_HEADERS.categories for t in of] + ["FINDINGS", "D E C I S I O N", "decision", "The Conclusion", "analysis"]
    glue = ["", " ", ".", ":", " [18]", "[3]", "8 ", "12 THE ", "He said. ", "so it is! ", "\"", "'", " makers must act", "\t", "the ", " follows.", "!? "]
    line = lambda: "".join(rng.choice([rng.choice(terms), rng.choice(glue)]) for _ in range(rng.randint(0, 4)))
    lines = lambda: rng.choice([line, lambda: rng.choice(["", "[2]", "short one", "a line that is clearly longer than twenty characters", "\u00a0x", "\r"])])()
    return ["\n".join(lines() for _ in range(rng.randint(0, 9))) for _ in range(n)] + ["", "DECISION", "\nDECISION\n\n", "DECISION\n[1]\n[2]\n[3]\nCONCLUSION\nx\ny\nz"]


@pytest.mark.parametrize("rules", [R.LEGAL_HEADERS, replace(R.LEGAL_HEADERS, strict=True), replace(R.LEGAL_HEADERS, ahead=())])
def test_headers_equal_a_plain_scan(spark, rules):
    cases = random_texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(-1, None)], "i int, t string").repartition(4)
    out = df.select("i", S.headers(F.col("t"), rules).alias("h"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.i: [h.asDict() for h in r.h] for r in out.collect()}
    assert got.pop(-1) == []
    assert got == {i: find_headers(t, rules) for i, t in enumerate(cases)}
    assert sum(map(len, got.values())) > 100


def test_lines_of_a_header_are_skipped_in_long_texts(spark):
    text = "DECISION\n[1]\n" * 3000
    df = spark.createDataFrame([(text,)], "t string")
    rules = replace(R.LEGAL_HEADERS, strict=True)
    assert [h.asDict() for h in df.select(S.headers(F.col("t"), rules).alias("h")).first().h] == find_headers(text, rules)


def test_sections_between_headers(spark):
    text = "lead\nDECISION\nfirst body is long enough to be one\nANALYSIS\nsecond\nthird\nDECISION\nlast body is long enough to be one"
    df = spark.createDataFrame([(text,), ("no headers",), (None,)], "t string")
    got = df.withColumn("h", S.headers(F.col("t"))).select(S.sections(F.col("t"), F.col("h")).alias("s")).collect()
    # of equal headers the first keeps its place and the last its content
    assert [(s.category, s.header, s.content) for s in got[0].s] == [("decision_headers", "DECISION", "last body is long enough to be one"), ("analysis_headers", "ANALYSIS", "second\nthird")]
    assert got[1].s == [] and got[2].s == []


def test_outcomes(spark):
    df = spark.createDataFrame([("So. The Appeal is  dismissed now.",), ("We reject it. And more.",), ("nothing",), ("claim is allowed, order is set aside",), ("they allowed it",)], "t string")
    got = [tuple(r.o) for r in df.select(S.outcome(F.col("t")).alias("o")).collect()]
    assert got[0] == ("dismissed", 0.9, "Appeal is  dismissed")
    assert got[1] == ("dismissed", 0.6, "We reject it.")
    assert got[2] == (None, 0.0, None)
    assert got[3][0] == "allowed" and got[4] == (None, 0.0, None)


def test_document_outcome_prefers_surer_sections(spark):
    rows = [
        ([("decision_headers", "a", "we grant it"), ("determination_headers", "b", "appeal is dismissed"), ("conclusion_headers", "c", "claim is allowed")],),
        ([("decision_headers", "a", "appeal is allowed"), ("conclusion_headers", "c", "claim is dismissed")],),
        ([("analysis_headers", "a", "appeal is allowed")],),
    ]
    df = spark.createDataFrame(rows, f"s {S.SECTIONS}")
    assert [r.o and r.o.outcome for r in df.select(S.document_outcome(F.col("s")).alias("o")).collect()] == ["dismissed", "allowed", None]


def test_preprocess_has_a_fixed_schema(spark):
    text = "Page 1 of 2\nXXXXX  said\nde la part des autres\nDECISION\nThe appeal is allowed for many reasons given.\nCONCLUSION\nend of the text"
    df = spark.createDataFrame([(1, text), (2, None), (3, " ")], "id bigint, full_text string")
    got = {r.id: r for r in S.preprocess(df).collect()}
    assert got[1].decision_outcome == "allowed" and got[1].has_decision_headers is True and got[1].has_analysis_headers is None
    assert "[REDACTED] said" in got[1].cleaned_text and "autres" not in got[1].cleaned_text and "Page" not in got[1].cleaned_text
    assert got[2].cleaned_text == "" and got[3].sections == [] and got[2].decision_headers_text is None


def test_marker_paragraphs(spark):
    long = "word " * 60
    texts = [
        "no marker here. none.",
        "Head one. Case 5 (CA IRB) begins. A b. C d.",
        f"Head (CA IRB) x. {long}. end (CA IRB).",
        f"a (CA IRB). {long}. b (CA IRB). short. c (CA IRB).",
        "a (CA IRB). short. b (CA IRB).",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.m for r in df.select(S.marker_paragraphs(F.col("t")).alias("m")).collect()]
    assert tuple(got[0]) == (None, None, None)
    assert got[1].general_metadata == "Head one. Case 5" and got[1].suspected_first_case_paragraph == "(CA IRB) begins. A b. C d." and got[1].suspected_last_case_paragraph is None
    assert got[2].suspected_last_case_paragraph.endswith("end (CA IRB).")
    assert got[3].suspected_last_case_paragraph.startswith("word") and got[3].suspected_last_case_paragraph.endswith("c (CA IRB).")
    assert got[4].suspected_last_case_paragraph is None


def test_lead_is_removed(spark):
    df = spark.createDataFrame([("meta (CA IRB) rest", "meta"), ("x (CA IRB) rest", "meta"), ("no marker", "meta")], "t string, m string")
    assert [r[0] for r in df.select(S.without_lead(F.col("t"), F.col("m"))).collect()] == ["(CA IRB) rest", "(CA IRB) rest", "no marker"]


def test_header_statistics(spark):
    df = spark.createDataFrame([(1, "ANALYSIS\nx\nNIL RETURN\nANALYSIS"), (2, "ANALYSIS\nA 1 2 3 4 5 6"), (3, None)], "id bigint, t string")
    counts = S.header_counts(S.header_lines(df, "id", "t"))
    assert dict(counts.collect()) == {"ANALYSIS": 3, "NIL RETURN": 1}
    assert dict(S.true_headers(counts).collect()) == {"ANALYSIS": 3}
