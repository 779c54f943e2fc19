import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from docloom.operators import keys
from docloom.plans import experiments, preprocess, staged
from docloom.sources import files, sinks
from docloom.streaming import scoring


def write(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)
    return str(path)


def test_delimiters_and_ragged_lines(spark, tmp_path):
    p = write(tmp_path / "a.csv", "id;t\n1;x;y\n2\n")
    assert files.sniff_delimiter(spark, p) == ";" and files.row_count(spark, p) == 2
    assert [tuple(r) for r in files.read_ragged(spark, p, ";").collect()] == [("1", "x;y"), ("2", None)]
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("id;note\n1;a\nid;note\n2;b;c\n" * 3)
    (folder / "b.csv").write_text("id;note\n7;x\n")
    (folder / "c.csv").write_text("8;no header\n")
    got = sorted(tuple(r) for r in files.read_ragged(spark, str(folder), ";").collect())
    # a file loses its first line only where that is the header
    assert got == sorted([("1", "a"), ("id", "note"), ("2", "b;c")] * 3 + [("id", "note")] * 2 + [("7", "x"), ("8", "no header")])
    assert files.sniff_delimiter(spark, write(tmp_path / "b.csv", "one\n")) == ","


def test_csv_round_trip_with_quotes_and_backslashes(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\\n, then\nnext', ["a"])], "id bigint, t string, x array<string>")
    sinks.write_csv(df, str(tmp_path / "o"), quote_all=True)
    r = files.read_csv(spark, str(tmp_path / "o"), ",", multiline=True).first()
    assert r.t == 'say "hi"\\n, then\nnext' and json.loads(r.x) == ["a"]
    assert files.read_column(spark, str(tmp_path / "o"), "t", ",", multiline=True).columns == ["t"]


def test_bad_lines_can_be_left_out(spark, tmp_path):
    p = write(tmp_path / "c.csv", "a,b\n1,2\nx,3\n")
    assert files.read_csv(spark, p, ",", "a int, b int", mode="DROPMALFORMED").collect() == [(1, 2)]


def test_json(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b", 0)], "text string, label int")
    sinks.write_json_array(df.coalesce(1), str(tmp_path / "arr"))
    part = next((tmp_path / "arr").glob("part-*"))
    assert [x["label"] for x in json.loads(part.read_text())] == [1, 0]
    assert files.read_json_array(spark, str(tmp_path / "arr")).count() == 2
    sinks.write_jsonl(df, str(tmp_path / "lines"))
    assert files.read_jsonl(spark, str(tmp_path / "lines"), "text string, label int").count() == 2
    prof = {r.key: (r.records, r.type) for r in files.jsonl_profile(spark, write(tmp_path / "p.jsonl", '{"a": 1, "b": [1], "c": "x"}\n{"a": 2}\n')).collect()}
    assert prof == {"a": (2, "number"), "b": (2, "array"), "c": (2, "string")}


def tar(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    return str(path)


def test_archives(spark, tmp_path):
    p = tar(tmp_path / "c.tar.gz", {"d/2010canlii12.txt": b"good \xff text", "d/notes.txt": b"no", "x.csv": b"id;v\n1;a\n2;b\n"})
    got = files.read_case_archive(spark, p).collect()
    assert [(r.year, r.decisionID) for r in got] == [("2010", "12")] and got[0].full_text.startswith("good ")
    assert [tuple(r) for r in files.read_archived_csv(spark, p, ";", "id int, v string").orderBy("id").collect()] == [(1, "a"), (2, "b")]
    assert {r.extension: r.members for r in files.archive_profile(spark, p).collect()} == {".txt": 2, ".csv": 1}
    x = tar(tmp_path / "c.tar.xz", {"2011canlii1.txt": b"a"}, "w:xz")
    assert files.read_case_archive(spark, x, first=1).first().year == "2011"


def test_case_folder(spark, tmp_path):
    for n in ("2012canlii7.txt", "readme.txt"):
        write(tmp_path / n, "line\nline")
    assert [tuple(r) for r in files.read_cases(spark, str(tmp_path)).collect()] == [("2012", "7", "line\nline")]


def test_configuration(spark, tmp_path):
    base = {"a": 1, "b": {"c": 2, "d": 3}}
    p = write(tmp_path / "c.json", json.dumps({"b": {"c": 9}}))
    assert files.load_config(spark, p, base) == {"a": 1, "b": {"c": 9, "d": 3}} and base["b"]["c"] == 2
    assert files.load_config(spark, None, base) == base
    assert sinks.plain({"x": {1, 2}, "y": object}) | {"y": ""} == {"x": [1, 2], "y": ""}
    assert sinks.run_name("a b/c").startswith("a_b_c_")


def case_tables(spark, folder):
    make = lambda name, rows, spec: spark.createDataFrame(rows, spec).write.parquet(f"{folder}/{name}")
    make("case_texts", [("1", "The appeal is allowed."), ("2", "b"), ("2", "c")], "decisionID string, full_text string")
    make("all_sentences", [("1", "s1", 0), ("3", "s3", 1), ("1", "s2", 2)], "decisionID string, Text string, ord bigint")
    make("determination", [("1", "d", 0)], "decisionID string, extracted_sentences_determination string, ord bigint")
    make("train", [("1", "x"), ("9.0", "y"), ("2", "z")], "decisionID string, decision_outcome string")
    make("test", [("3", "x"), ("bad", "y"), ("bad", "y")], "decisionID string, decision_outcome string")
    make("case_cover", [("1", "c")], "decisionID string, c string")
    make("entities", [("1", "e")], "decisionID string, decision_outcome string")


def test_preprocessing(spark, tmp_path):
    case_tables(spark, f"{tmp_path}/in")
    out = preprocess.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    train = {r.decisionID: r for r in spark.read.parquet(out["enriched/train"]).collect()}
    assert sorted(train) == [1, 9] and train[1].sentence_text == "s1 s2" and train[1].decision_outcome_estimated == "e" and train[1].determination_count == 1
    report = preprocess.report(spark, out | {"none": f"{tmp_path}/none"})
    assert report["none"]["exists"] is False and report["unused/train"]["rows"] == 1
    with pytest.raises(FileNotFoundError):
        preprocess.run(spark, f"{tmp_path}/out", f"{tmp_path}/x")
    assert files.load_split(spark, f"{tmp_path}/in")[0].count() == 3
    assert files.latest(spark, str(tmp_path), "o").endswith("/out")


def test_staged_pipeline(spark, tmp_path):
    text = "DECISION\nThe appeal is dismissed for these reasons alone.\nANALYSIS\nI find it so. The panel is satisfied."
    docs = spark.createDataFrame([(1, text, 1), (2, None, 0)], "decisionID bigint, full_text string, determination_count bigint")

    def scorer(batches):
        for s in batches:
            yield s.str.contains("dismissed").astype(float)

    ctx = staged.Context(examples=spark.createDataFrame([("the appeal is dismissed for these reasons",)], "text string"), scorers={"neural_a": scorer})
    out = staged.run(spark, docs, str(tmp_path), {"name": "t", "active_stages": ["text_processing", "sparse", "basic", "ngram", "neural_a"]}, ctx)
    assert [s["stage"] for s in out["stages"]] == ["text_processing", "sparse", "basic", "ngram", "neural_a"]
    r = {x.decisionID: x for x in spark.read.parquet(out["final"]).collect()}
    assert r[1].sparse_explicit_extraction_count >= 1 and r[1].decision_headers_text_basic_extraction[0].score == 20.0
    assert r[1].decision_headers_text_ngram_extraction_count == 1 and r[1].cleaned_text_neural_a_extraction_count == 1
    assert r[2].decision_headers_text_basic_extraction == [] and r[1].decision_outcome == "dismissed"
    wide = spark.read.parquet(out["final"])
    assert staged.section_report(wide, "decision_headers_text", "basic", "decisionID").first().n == 1
    with pytest.raises(ValueError, match="unknown"):
        staged.run(spark, docs, str(tmp_path), {"active_stages": ["nothing"]}, ctx)


def test_experiments(spark):
    from docloom.operators import extract

    docs = spark.createDataFrame([(1, "The appeal is dismissed. x", 3), (2, "nothing", 0)], "id bigint, full_text string, determination_count bigint")
    expected = spark.createDataFrame([(1, "the appeal is dismissed."), (1, "lost")], "id bigint, text string")
    run = lambda d: extract.basic(d, ["id"], "full_text")
    out = experiments.run_experiment(experiments.Experiment("e", {"basic": run}), docs, expected, "id").first()
    assert out.extractor == "basic" and out.total_cases == 2
    assert experiments.run_evaluation(docs, run, expected, "id")["under"].first().missing == ["lost"]
    ex = spark.createDataFrame([(1, "The appeal is dismissed", 1), (2, "no", 1)], "id bigint, text string, label int")
    m = experiments.evaluate_labels(ex, lambda d: extract.basic_candidates(d, ["id"], "text"), "id").first()
    assert (m.tp, m.fn, m.recall) == (1, 1, 0.5)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "The appeal is allowed. Nothing.")], "id bigint, t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, t string").parquet(f"{tmp_path}/in")
    q = scoring.score_stream(stream, "id", "t").writeStream.format("memory").queryName("scored").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    assert [r.score for r in spark.table("scored").collect()] == [20.0]


def test_numbering_follows_the_order(spark):
    df = spark.createDataFrame([(1, 5), (1, 2), (2, 9)], "k bigint, o bigint")
    assert sorted((r.k, r.o, r.sentence_order) for r in keys.number_rows(df, "k", [F.col("o")]).collect()) == [(1, 2, 1), (1, 5, 2), (2, 9, 1)]


def test_folder_with_archives_and_labels(spark, tmp_path):
    write(tmp_path / "a.csv", "decisionID,v\n7,x\nbad,y\n")
    tar(tmp_path / "b.tar.gz", {"b.csv": b"decisionID;v\n1;a\n"})
    got = files.load_folder(spark, str(tmp_path), "decisionID", {"b.tar.gz": (";", "decisionID string, v string")})
    assert sorted(r.decisionID for r in got["a.csv"].collect()) == [-999, 7] and got["b.tar.gz"].first().decisionID == 1
    assert files.labelled(spark.createDataFrame([("a", "1")], "text string, label string")).first().label == 1
    with pytest.raises(ValueError, match="0 or 1"):
        files.labelled(spark.createDataFrame([("a", 2)], "text string, label int"))


def test_trained_scorer(spark):
    from docloom.operators import scorers

    rows = [(f"the appeal number {i} is dismissed", 1) for i in range(30)] + [(f"the hearing number {i} took place", 0) for i in range(60)]
    model = scorers.train(spark.createDataFrame(rows, "text string, label int"))
    got = scorers.probabilities(spark.createDataFrame([(1, "an appeal is dismissed"), (2, "a hearing took place"), (3, None)], "id int, text string"), model)
    p = {r.id: r.prob for r in got.collect()}
    assert p[1] > 0.5 > p[2] and 0 <= p[3] <= 1


def test_reports_and_command_line(spark, tmp_path):
    from docloom import __main__ as cli
    from docloom.plans import reports

    df = spark.createDataFrame([(1, ["<b>"], 0.5)], "id int, missing array<string>, r double")
    assert "&lt;b&gt;" in reports.html(df, "t") and "r: 0.5000" in reports.text(df, "t")
    case_tables(spark, f"{tmp_path}/in")
    assert cli.main(["preprocess", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert cli.main(["extract", f"{tmp_path}/in/case_texts", f"{tmp_path}/runs", "--stage", "sparse"]) == 0
    assert cli.main(["headers", f"{tmp_path}/in/case_texts", "decisionID", "full_text"]) == 0


def test_header_comparison(spark):
    from docloom.operators import sections

    a = spark.createDataFrame([(1, "ANALYSIS\nREASONS")], "id int, t string")
    b = spark.createDataFrame([(1, "ANALYSIS\nORDER")], "id int, t string")
    assert {r.header: r.side for r in sections.compare_headers(a, b, "id", "t", 1).collect()} == {"ANALYSIS": "both", "REASONS": "only_a", "ORDER": "only_b"}
