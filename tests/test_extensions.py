import json
import zipfile

import pytest
from pyspark.sql import functions as F

from docloom import __main__ as command
from docloom.functions import parameters
from docloom.operators import extract, scorers
from docloom.plans import experiments
from docloom.sources import sheets

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def test_sheet_round_trip(spark, tmp_path):
    rows = [(1, 'a < b & "c"', 1.5, True), (2, " é\n\x07 ", None, False), (3, None, -2.25, None)]
    df = spark.createDataFrame(rows, "id bigint, t string, x double, b boolean")
    sheets.write_sheet(df.orderBy("id"), str(tmp_path / "a.xlsx"))
    got = sheets.read_sheets(spark, str(tmp_path / "a.xlsx"))
    assert got.columns == df.columns
    assert [tuple(r) for r in got.collect()] == [("1", 'a < b & "c"', "1.5", "true"), ("2", " é\n ", None, "false"), ("3", None, "-2.25", None)]
    with pytest.raises(Exception, match="absent"):
        sheets.read_sheets(spark, str(tmp_path / "absent.xlsx"))


def test_sheet_with_shared_strings_and_gaps(tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {main}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row r="2"><c r="AB2"><v>7</v></c></row></sheetData></worksheet>')
    assert sheets.parsed((tmp_path / "b.xlsx").read_bytes()) == [["name", None, "rich text"], [None] * 27 + ["7"]]
    assert [sheets.column_name(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"] and sheets.column_number("AAA12") == 702


def test_parameters_by_name_and_paths():
    assert parameters.training_parameters("any/legal-bert")["epochs"] == 7
    assert parameters.training_parameters("RoBERTa-base")["batch_size"] == 24 and parameters.training_parameters("RoBERTa-base")["max_length"] == 256
    assert parameters.training_parameters("x-DeBERTa-v3")["fixed_gamma"] == 1.5
    there = {"/base/a.json", "/pipe/b.json", "/base/b.json"}
    assert [parameters.resolved(p, ("/pipe/", "/base"), there.__contains__) for p in ("a.json", "b.json", "c.json")] == ["/base/a.json", "/pipe/b.json", "c.json"]


def test_tokenised_scorer_cuts_and_keeps_order(spark):
    texts = ["One two three four five.", "Short words only here.", "The long " + "word " * 900 + "end."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id bigint, t string")
    ids = {r.id: r.ids for r in df.select("id", scorers.token_ids(F.col("t"), TOKENIZER, 16).alias("ids")).collect()}
    assert all(0 < len(x) <= 16 for x in ids.values()) and len(ids[2]) == 16
    scorer = scorers.tokenised(TOKENIZER, lambda: lambda batch: [len(x) / 16 for x in batch], 16, 2)
    got = {r.id: r.score for r in extract.Neural(scorer, 0.0).extract(df, ["id"], "t").collect()}
    assert got == {i: len(x) / 16 for i, x in ids.items()}


def test_extractors_share_a_form(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The appeal is allowed. Nothing else."), (2, "No such thing here.")], "id bigint, t string")
    for e in (extract.Sparse(), extract.Basic(), extract.Ngram(extract.gram_bank(docs.select(F.lit("The appeal is allowed.").alias("text"))))):
        assert isinstance(e, extract.Extractor)
        assert "The appeal is allowed" in {r.text.rstrip(".") for r in e.extract(docs, ["id"], "t").collect()}
    found = experiments.performance(lambda d: extract.Sparse().extract(d, ["id"], "t"), docs, "id", str(tmp_path / "p"))
    assert found["cases"] == 2 and found["total_ms"] > 0 and found["average_ms"] == found["total_ms"] / 2


def test_commands(spark, tmp_path, capsys):
    docs = spark.createDataFrame([(1, "The appeal is allowed. Some words follow."), (2, "Some other words 50 stand here.")], "decisionID bigint, full_text string")
    docs.write.parquet(str(tmp_path / "in"))
    assert command.main(["sparse", str(tmp_path / "in"), str(tmp_path / "out")]) == 0
    assert json.loads(capsys.readouterr().out)[0]["statistics"]["sparse_explicit_extraction_count"]["documents"] == 1
    docs.limit(1).select("decisionID", F.lit("The appeal is allowed.").alias("text")).write.parquet(str(tmp_path / "want"))
    assert command.main(["evaluate", str(tmp_path / "in"), str(tmp_path / "want"), "--extractor", "sparse"]) == 0
    assert json.loads(capsys.readouterr().out)["total_cases"] == 2
    examples = spark.createDataFrame([(f"The appeal number {i} is allowed", 1) for i in range(20)] + [(f"Some other words {i} stand here", 0) for i in range(20)], "text string, label int")
    examples.write.json(str(tmp_path / "ex"))
    assert command.main(["train", str(tmp_path / "ex"), str(tmp_path / "model")]) == 0
    assert command.main(["neural", str(tmp_path / "in"), str(tmp_path / "hits"), "--model", str(tmp_path / "model")]) == 0
    assert {r.decisionID for r in spark.read.parquet(str(tmp_path / "hits")).collect()} == {1}
    examples.limit(3).write.json(str(tmp_path / "silver"))
    assert command.main(["split", str(tmp_path / "ex"), str(tmp_path / "silver"), str(tmp_path / "split")]) == 0
    assert spark.read.parquet(str(tmp_path / "split/test")).count() == 40
