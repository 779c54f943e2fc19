import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.sources import files


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()[0]


CASES = [
    (T.clean, "The [Appeal] isn't A.B ``done``!", "the appeal isn't a b done"),
    (T.clean, "Café déjà-vu ''x''", "café déjà vu x"),
    (T.clean, None, ""),
    (T.clean_for_grams, "Appeal isallowed; it's OVER", "appeal is allowed it's over"),
    (T.clean_for_grams, None, ""),
    (T.clean_sentence, "  ['The Appeal isallowed.'] ", "the appeal is allowed"),
    (T.clean_sentence, "[[appeal is allowed]]", "appeal is allowed"),
    (T.clean_sentence, "appeal is allowed.the", "appeal is allowed the"),
    (T.clean_sentence, "The claimants, ", "the claimant s"),
    (T.clean_example, "['Appeal  isallowed.the end']", "Appeal is allowed. The end"),
    (T.clean_example, '"', None),
    (T.normalize_punctuation, "a .b.  c . . ", "a. b. c."),
    (T.normalize_punctuation, " . ", ""),
    (T.remove_ids, "see File No. X-1 and (CA IRB) 2010 CanLII 55", "see  and  "),
    (T.clean_for_training, "Claim [3] of 12 May 2010\\n(see x) is dismissed", "Claim  of   is dismissed."),
    (T.clean_for_training, "12-13 / ", ""),
    (T.clean_for_training, None, ""),
    (T.normalize_whitespace, " a  b \n\n\n c\n d ", "a b\n\nc\n\nd"),
    (T.clean_redactions, "XX XXX XXXXX [REDACTION]", "XX [REDACTED] [REDACTED] [REDACTED]"),
    (T.remove_page_pointers, "x Page 3 of 10 y", "x  y"),
    (T.remove_page_pointers, " 12 ", ""),
    (T.remove_page_pointers, "a\n12\nb", "a\n12\nb"),
    (T.normalize_header, "  'Reasons'   for \"decision\".", "REASONS FOR DECISION"),
    (T.clean_for_model, "['It was\\nsaid on May 3, 2010 [5] that 123456 x']", "It was said on that x"),
    (T.clean_for_model, '{"a": "one", "b": "two"}', "one two"),
    (T.clean_for_model, "Date: 3 May  then (signed) J. Doe", "then"),
    (T.sentences, "One two. Three?\nFour! ", ["One two.", "Three?", "Four!"]),
    (T.sentences, None, []),
    (T.clauses, "A, b; c and d. 12. e] [f", ["A", "b", "c", "d", "e]", "[f"]),
    (T.listed_clauses, "['appeal is allowed', 'x and y', '5']", ["appeal is allowed", "x", "y"]),
    (T.listed_clauses, "no list", None),
    (T.model_sentences, "He said it again. It was done then. no. Client id number 5 here. 1 2 3 four.", ["He said it again.", "It was done then. no."]),
    (T.parse_list_text, "['a b', 'c']", ["a b", "c"]),
    (T.parse_list_text, "plain text", ["plain text"]),
    (T.parse_list_text, " ", []),
    (T.parse_example_text, "[{'text': 'a'}, {'text': 'b'}]", ["a", "b"]),
    (T.parse_example_text, "['a', 'b']", ["a", "b"]),
    (T.parse_example_text, "{'text': 'a'}", ["a"]),
    (T.parse_example_text, "[broken", ["[broken"]),
    (T.parse_example_text, "", []),
    (T.header_candidates, "REASONS FOR DECISION\nnot one\nXXXXX\nTA5-12331\nIV.\n ANALYSIS \nA B C D E F G", ["REASONS FOR DECISION", "ANALYSIS"]),
    (T.ngrams, "a b c d", ["a b", "b c", "c d", "a b c", "b c d", "a b c d"]),
    (T.ngrams, "a", []),
    (T.words, " a\tb \n", ["a", "b"]),
    (T.words, " ", []),
    (T.remove_foreign_lines, "a normal line\nde la part des autres\nVous n'avez qu'à en faire\n\nend", "a normal line\n\nend"),
    (files.literal_list, "['a', \"it's\", 3]", ["a", "it's", "3"]),
    (files.literal_list, "not a list", []),
]


@pytest.mark.parametrize(("function", "given", "want"), CASES)
def test_function(spark, function, given, want):
    assert one(spark, function, given) == want


def test_metadata_is_cut_out_once(spark):
    text = "start\nREFUGEE PROTECTION DIVISION / a / b / c\nend"
    r = one(spark, T.extract_metadata, text)
    assert (r.text, r.metadata) == ("start\n\nend", "REFUGEE PROTECTION DIVISION / a / b / c")
    r = one(spark, T.extract_metadata, "x NEGATIVE / AB / CD y")
    assert (r.text, r.metadata) == ("x NEGATIVE / AB / CD y", None)
    assert one(spark, T.extract_metadata, "x MALE / NEGATIVE / CD").metadata == "MALE / NEGATIVE / CD"


def test_whitespace_is_idempotent(spark):
    for t in ("a\n\n\n b  c ", "", "\n", "x\ty \n z"):
        once = one(spark, T.normalize_whitespace, t)
        assert one(spark, T.normalize_whitespace, once) == once


def test_keywords_and_bounds(spark):
    assert one(spark, T.has_keyword, "He Determined that")
    assert not one(spark, T.has_keyword, "nothing")
    assert one(spark, lambda c: T.bounded(c, "thus"), "thus it is")
    assert not one(spark, lambda c: T.bounded(c, "thus"), "thus, it is")


def test_span_classes(spark):
    rows = [("A Determination", [("DETERMINATION",)]), ("a determination", [("OTHER",)]), ("none", None), ("x", [(None,)])]
    df = spark.createDataFrame(rows, "text string, spans array<struct<label:string>>")
    assert [r[0] for r in df.select(T.span_class(F.col("text"), F.col("spans"))).collect()] == [1, 2, 0, 0]


def test_extraction_field_with_an_apostrophe_is_empty(spark):
    assert [r.text for r in one(spark, T.parse_extractions, "[{'text': 'a b', 'score': 5.0}]")] == ["a b"]
    assert one(spark, T.parse_extractions, "[{'text': 'it's', 'score': 5.0}]") == []
    assert one(spark, T.parse_extractions, None) == []


def test_augment_drops_or_swaps(spark):
    df = spark.range(400).select("id", F.lit("a b c d e f").alias("t"))
    rows = [r[0].split() for r in df.select(T.augment(F.col("t"), F.col("id"))).collect()]
    full = "a b c d e f".split()
    shorter = sum(len(r) == 5 for r in rows)
    moved = sum(r != [w for w in full if w in r] for r in rows)
    assert 30 < shorter < 95 and 15 < moved < 75
    assert all(len(r) >= 5 and set(r) <= set(full) and len(set(r)) == len(r) for r in rows)
    assert one(spark, lambda c: T.augment(c, F.lit(1)), "a b c") == "a b c"


def test_ascii_json(spark):
    df = spark.createDataFrame([({"a": "é\n"},)], "m map<string,string>")
    assert df.select(files.ascii_json(F.col("m"))).first()[0] == '{"a": "\\u00e9\\n"}'


def test_packs_compile(spark):
    df = spark.createDataFrame([("x",)], "c string")
    for p in (R.one_of(R.LEGAL_SPARSE.patterns), R.one_of(R.LEGAL_NGRAM.direct, False), *(R.one_of(c.patterns) for c in R.LEGAL_BASIC.classes if c.patterns)):
        assert df.select(F.col("c").rlike(p)).first()[0] is False
