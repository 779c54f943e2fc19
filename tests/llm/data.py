"""Small documents with the cases every operator must define."""

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, host string, size bigint"

PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix a potion of old words and new ones. "


def documents(spark, extra=()):
    """Nulls in every column, empty and long texts, ties, repeated rows, extra columns with clashing names."""
    rows = [
        (1, PROSE * 3, "en", "a", 300, "h", 1),
        (2, PROSE * 3, "en", "a", 300, "h", 1),
        (2, PROSE * 3, "en", "a", 300, "h", 1),
        (3, "", "en", "b", 0, None, None),
        (4, None, None, None, None, None, None),
        (5, " \t\n\x0b\f\r ", "fr", "b", 7, "x", 2),
        (6, "Ünï côde \U0001f600 wörds\nand lines", "de", "b", 30, "x", 3),
        (7, "\n".join(f"line {i} of a very long text {i * i}" for i in range(5000)), "en", "c", 200000, "x", 4),
        (8, "one", "en", "c", 3, "x", 5),
        (9, "one two", "en", None, 7, "x", 5),
        (10, "one two three", "en", "a", 13, "x", 5),
        (None, "no id at all", "en", "a", 12, "x", 5),
    ]
    return spark.createDataFrame(rows + list(extra), DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
