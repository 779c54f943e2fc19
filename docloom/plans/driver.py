"""The registry of driver queries: each applies an operator to the driver's tables; most have their SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.operators import aggregates, datasets, dedup, enrich, evaluate, extract, keys, sections
from docloom.sources import files

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    from docloom.plans import driver_chain, driver_io  # noqa: F401  add their queries


def queries() -> dict[str, Query]:
    _all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(_SQL)


def oracle_text(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _SQL[name]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return basic_selection(spark, sf_dir)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents, for work that costs more than moving them."""
    return files.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


# Packs that the generated prose has something for.
PACK = R.BasicRules(
    classes=(
        R.ScoreClass("license", 20.0, phrases=("license", "rights reserved")),
        R.ScoreClass("numbers", 10.0, patterns=(r"[0-9]{2,}",)),
        R.ScoreClass("pairs", 5.0, patterns=(r"\bof\s+the\b", r"\bde\s+la\b")),
    ),
    exact=("All rights reserved.", "Of."),
    keywords=("the", "and", "die", "le"),
    outcomes=("is", "ist", "est"),
)
SPARSE_PACK = R.SparseRules(
    phrases=("all rights reserved", "of", "the"),
    prefixes=("released", "licensed"),
    prefix_needs="license",
    patterns=(r"version\s+[0-9]+", r"\bof\s+the\s+\w+\b"),
    rewrites=(("isthe", "is the"), ("ofthe", "of the")),
)
OUTCOME_PACK = R.OutcomeRules(
    patterns=(("licensed", (r"licensed\s+under", r"released\s+under")), ("reserved", (r"rights\s+reserved",))),
    keywords=(("plain", ("the", "die")), ("other", ("la", "el"))),
)
STOP_WORDS = ("de", "la", "le", "les", "des", "et", "en", "un")

#: RE2's counterpart of Unicode word characters and blanks, and of trimming them.
_W, _S = r"[\p{L}\p{M}\p{Nd}\p{Pc}]", r"[\t-\r \x{85}\x{A0}\x{2028}\x{2029}]"


def _sub(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, '{pattern}', '{to}', 'g')"


def _strip(t: str) -> str:
    return _sub(t, rf"^{_S}+|{_S}+$", "")


def _sentences(t: str) -> str:
    cut = f"regexp_replace({_sub(t, r'\n+', ' ')}, '([.!?]){_S}+', '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(1)), lambda x: {_strip('x')}), lambda x: x <> '')"


def _words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{_S}+'), lambda x: x <> '')"


def _bounded(t: str, word: str) -> str:
    return f"contains(' ' || {t} || ' ', ' {word} ')"


# -- keys, de-duplication, joins --


def _dirty(c: str) -> Column:
    k = F.col(c)
    return F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.concat(F.lit("x"), k)).when(k % 3 == 0, F.concat(k.cast("string"), F.lit(".0"))).otherwise(k.cast("string"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1 WHEN o_orderkey % 5 = 0 THEN -999 ELSE o_orderkey END AS safe,
  CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN -1 ELSE o_orderkey END AS lenient FROM orders""")
def safe_ids(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", _dirty("o_orderkey").alias("raw"))
    return o.select("o_orderkey", keys.safe_id(F.col("raw")).alias("safe"), keys.lenient_id(F.col("raw")).alias("lenient"))


@query("SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey) AS sentence_order FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem)")
def row_numbers(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return keys.number_rows(rows, "l_orderkey", [F.col("l_shipdate"), F.col("l_linenumber"), F.col("l_partkey")])


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 10")
def hashed_sample(spark, d):
    return keys.sample(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 10)


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("text_md5"))
    bad = dedup.duplicate_keys(docs, "text_md5", strict=False)
    return dedup.split_by_keys(docs, bad, "text_md5")[1].groupBy("text_md5").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH texts AS (SELECT n_chars AS id FROM documents), test AS (SELECT l_partkey AS id FROM lineitem), other AS (SELECT o_custkey AS id FROM orders),
  own AS (SELECT id FROM texts GROUP BY id HAVING count(*) > 1), dup AS (SELECT id FROM test GROUP BY id HAVING count(*) > 1 UNION SELECT id FROM own)
  SELECT 'case_texts' AS name, id, id NOT IN (SELECT id FROM own) AS clean, count(*) AS n FROM texts GROUP BY id
  UNION ALL SELECT 'test', id, id NOT IN (SELECT id FROM dup), count(*) FROM test GROUP BY id
  UNION ALL SELECT 'other', id, id NOT IN (SELECT id FROM dup), count(*) FROM other GROUP BY id""")
def purge_duplicates(spark, d):
    """Rows by table, id and whether they stay or go to the unused ones."""
    tables = {
        "case_texts": table(spark, d, "documents").select(F.col("n_chars").alias("id"), "doc_id"),
        "test": table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("doc_id")),
        "other": table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("doc_id")),
    }
    clean, unused = dedup.purge(tables, "id")
    out = None
    for n in tables:
        for rows, kept in ((clean[n], True), (unused[n], False)):
            counted = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "id", F.lit(kept).alias("clean"), "n")
            out = counted if out is None else out.unionByName(counted)
    return out


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_by_key(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return dedup.first_by(rows, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).drop("o_orderdate")


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(text)) ORDER BY doc_id) = 1")
def first_text(spark, d):
    return dedup.first_text(table(spark, d, "documents").select("doc_id", "lang", "text"), "text", [F.col("doc_id")]).select("doc_id", "lang")


@query("""SELECT coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' ELSE 'both' END AS side
  FROM (SELECT DISTINCT doc_id AS v FROM documents) a FULL JOIN (SELECT DISTINCT doc_id + 200 AS v FROM labels) b ON a.v = b.v""")
def vocabularies(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("v"))
    return dedup.vocabulary(a, table(spark, d, "labels").select((F.col("doc_id") + 200).alias("v")), "v")


@query("""SELECT d.doc_id, (l.doc_id IS NOT NULL) AS labelled FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def id_sets(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    both = dedup.common_keys(docs, labels, "doc_id").withColumn("labelled", F.lit(True))
    return both.unionByName(dedup.missing_keys(docs, labels, "doc_id").withColumn("labelled", F.lit(False)))


@query("SELECT doc_id, lang, source FROM documents WHERE (lang, source) NOT IN (SELECT (lang, source) FROM documents WHERE n_chars > 10000)")
def value_exclusion(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return dedup.without_values(docs, docs.where("n_chars > 10000"), ["lang", "source"]).drop("n_chars")


@query("""SELECT d.doc_id, d.lang, coalesce(l.n, 0) AS n, coalesce(l.quality, -1) AS quality FROM documents d
  LEFT JOIN (SELECT doc_id, count(*) AS n, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""")
def enrich_left(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("quality").alias("quality"))
    out = enrich.left_unique(table(spark, d, "documents").select("doc_id", "lang"), labels, "doc_id", [F.col("quality")])
    return enrich.filled(out, counts=("n",)).withColumn("quality", F.coalesce("quality", F.lit(-1)))


@query("""WITH e AS (SELECT conv_id, turn, text AS t FROM conversations WHERE role = 'user'), f AS (SELECT conv_id, text AS t FROM conversations WHERE role = 'assistant')
  SELECT conv_id, turn FROM e WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.conv_id = e.conv_id AND
    (contains(lower(trim(e.t)), lower(trim(f.t))) OR contains(lower(trim(f.t)), lower(trim(e.t)))))""")
def unmatched_texts(spark, d):
    c = table(spark, d, "conversations")
    return enrich.unmatched(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id", "text").select("conv_id", "turn")


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn, text)) AS joined FROM conversations GROUP BY conv_id")
def joined_texts(spark, d):
    out = enrich.joined_text(table(spark, d, "conversations"), "conv_id", "text", "turn", "joined")
    return out.select("conv_id", F.md5("joined").alias("joined"))


@query("SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY l_orderkey")
def listed_values(spark, d):
    out = enrich.listed(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber", "parts", "n")
    return out.select("l_orderkey", F.array_join(F.transform("parts", lambda x: x.cast("string")), ",").alias("parts"), "n")


# -- aggregates --


@query("SELECT source, count(*) AS count FROM documents GROUP BY source")
def value_counts(spark, d):
    return aggregates.value_counts(table(spark, d, "documents"), "source")


@query("""SELECT event_type, count(*) AS total, count(*) FILTER (value >= 50) AS filtered, count(DISTINCT CASE WHEN value >= 50 THEN user_id END) AS documents_with_extractions
  FROM events GROUP BY ROLLUP (event_type)""")
def section_statistics(spark, d):
    return aggregates.section_statistics(table(spark, d, "events"), "event_type", "user_id", "value", 50.0)


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
  SELECT line, count(*) AS count FROM l GROUP BY line ORDER BY count DESC, min(doc_id * 1000000 + pos), line LIMIT 20""")
def top_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return aggregates.top_values(lines.withColumn("seen", F.col("doc_id") * 1_000_000 + F.col("pos")), "line", "seen", 20)


@query("""SELECT e.category, e.value, count(v.event_type) AS count FROM (VALUES ('a', 'click'), ('a', 'view'), ('b', 'purchase'), ('b', 'nothing')) e(category, value)
  LEFT JOIN events v ON v.event_type = e.value GROUP BY e.category, e.value""")
def dictionary_counts(spark, d):
    return aggregates.dictionary_counts(table(spark, d, "events"), "event_type", (("a", ("click", "view")), ("b", ("purchase", "nothing"))))


@query("""SELECT CAST(CASE WHEN q > 100 THEN ceil(q / 10) * 10 ELSE ceil(q / 5) * 5 END AS DOUBLE) AS maximum
  FROM (SELECT greatest(0, quantile_cont(l_quantity, 0.995), quantile_cont(l_discount, 0.995)) AS q FROM lineitem)""")
def axis_maximum(spark, d):
    return aggregates.axis_maximum(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])


@query("SELECT least(CAST(floor(n_chars / 500.0) AS BIGINT), 59) AS bin, count(*) AS count FROM documents WHERE n_chars BETWEEN 0 AND 30000 GROUP BY 1")
def histogram(spark, d):
    return aggregates.histogram(table(spark, d, "documents"), "n_chars", 500, 30_000)


@query("""SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, median(l_quantity) AS median, round(stddev_samp(l_quantity), 6) AS std,
  round(avg(l_quantity / nullif(l_linenumber, 0)), 6) AS mean_ratio FROM lineitem GROUP BY l_returnflag""")
def describe(spark, d):
    out = aggregates.describe(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_linenumber")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std", "mean_ratio")})


@query("""WITH s AS (SELECT o_orderpriority AS p, avg(o_totalprice) + 1.5 * stddev_samp(o_totalprice) AS lim FROM orders GROUP BY 1)
  SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank
  FROM orders JOIN s ON p = o_orderpriority WHERE o_totalprice > lim QUALIFY rank <= 3""")
def outliers(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return aggregates.outliers(rows, "o_orderpriority", "o_totalprice", "o_orderkey", 1.5).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT coalesce(CAST(quality AS VARCHAR), 'all') AS quality, coalesce(CAST(toxic AS VARCHAR), 'all') AS toxic, count(*) AS count, CAST(grouping(quality, toxic) AS BIGINT) AS margin FROM labels GROUP BY CUBE (quality, toxic)")
def crosstab(spark, d):
    out = aggregates.crosstab(table(spark, d, "labels"), "quality", "toxic")
    return out.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("all")) for c in ("quality", "toxic")})


@query("""SELECT quality, count(*) AS count, round(least(2.0, greatest(0.5, sum(count(*)) OVER () / (count(*) OVER () * count(*)))), 9) AS weight FROM labels GROUP BY quality""")
def class_weights(spark, d):
    out = aggregates.class_weights(table(spark, d, "labels"), "quality")
    return out.withColumn("weight", F.round("weight", 9))


@query("SELECT count(text) AS n, round(avg(length(text)), 6) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM documents")
def length_statistics(spark, d):
    return aggregates.length_statistics(table(spark, d, "documents"), "text").withColumn("mean", F.round("mean", 6))


@query("""SELECT (SELECT count(*) FROM documents) AS before_rows, (SELECT count(DISTINCT source) FROM documents) AS before_ids, count(*) AS after_rows, count(DISTINCT source) AS after_ids,
  round(((SELECT count(*) FROM documents) - count(*)) * 100.0 / (SELECT count(*) FROM documents), 6) AS reduction FROM documents WHERE lang = 'en'""")
def validation_summary(spark, d):
    docs = table(spark, d, "documents")
    return aggregates.validation_summary(docs, docs.where("lang = 'en'"), "source").withColumn("reduction", F.round("reduction", 6))


@query("""WITH f AS (SELECT * FROM region ORDER BY r_regionkey LIMIT 3)
  SELECT 0 AS position, 'r_regionkey' AS name, 'int' AS type, (SELECT string_agg(CAST(r_regionkey AS VARCHAR), '|' ORDER BY r_regionkey) FROM f) AS samples
  UNION ALL SELECT 1, 'r_name', 'string', (SELECT string_agg(r_name, '|' ORDER BY r_regionkey) FROM f) UNION ALL SELECT 2, 'none', 'string', 'NaN|NaN|NaN'""")
def column_profile(spark, d):
    rows = table(spark, d, "region").orderBy("r_regionkey").withColumn("none", F.lit(None).cast("string"))
    return aggregates.column_profile(rows).withColumn("samples", F.array_join("samples", "|"))


# -- text --


def _each(column) -> Query:
    return lambda spark, d: texts(spark, d).select("doc_id", F.md5(column(F.col("text"))).alias("h"))


_KEEP = _sub(_sub(_sub("t", rf"({_W})''({_W})", r"\1§\2"), rf"[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\t-\r \x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}§]", " "), "§", "''")


@query(f"""SELECT doc_id, md5({_strip(_sub(_KEEP, _S + '+', ' '))}) AS h
  FROM (SELECT doc_id, {_sub(_sub("lower(text)", chr(92) + "[|" + chr(92) + "]|" + "''" + "''" + "|``", " "), rf"({_W})[.]({_W})", chr(92) + "1. " + chr(92) + "2")} AS t FROM documents)""")
def clean_text(spark, d):
    return _each(T.clean)(spark, d)


@query(f"""SELECT doc_id, md5(CASE WHEN t = '' THEN t ELSE t || '.' END) AS h
  FROM (SELECT doc_id, rtrim({_sub(_sub("text", _S + "+[.]", "."), "[.]" + _S + "*", ". ")}, '. ') AS t FROM documents)""")
def normalize_punctuation(spark, d):
    return _each(T.normalize_punctuation)(spark, d)


@query(f"""SELECT doc_id, md5({_strip(f"array_to_string(list_transform(string_split({_sub(_sub('text', ' +', ' '), chr(92) + 'n+', chr(10) + chr(10))}, chr(10)), lambda x: {_strip('x')}), chr(10))")}) AS h FROM documents""")
def normalize_whitespace(spark, d):
    return _each(T.normalize_whitespace)(spark, d)


_FOREIGN = f"len(list_filter({_words('lower(x)')}, lambda w: w IN ({', '.join(repr(w) for w in STOP_WORDS)}))) > 0.3 * len({_words('lower(x)')})"


@query(f"""SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (len({_words('x')}) > 0 AND {_FOREIGN})), chr(10))) AS h FROM documents""")
def remove_foreign_lines(spark, d):
    return _each(lambda c: T.remove_foreign_lines(c, STOP_WORDS, ()))(spark, d)


@query(f"SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(array_to_string(s, chr(1))) AS h FROM (SELECT doc_id, {_sentences('text')} AS s FROM documents)")
def sentence_split(spark, d):
    s = table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "\x01")).alias("h"))


@query(r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS x FROM documents),
  h AS (SELECT regexp_replace(regexp_extract(x, '^\s*([A-Z][A-Z\s\d\.\-\:]{2,})\s*$', 1), '^\s+|\s+$', '', 'g') AS header FROM l WHERE regexp_matches(x, '^\s*([A-Z][A-Z\s\d\.\-\:]{2,})\s*$'))
  SELECT header, count(*) AS count FROM h WHERE NOT regexp_matches(header, '^[A-Z]{1,2}\d+\s*-\s*\d+|^X+$|^X+\s+X+|^\d+$|^[A-Z]\.$|^[IVX]+\.$|^[A-Z]{1,2}\d+$')
  AND (length(header) - length(replace(header, 'X', ''))) * 2 <= length(header) AND len(regexp_split_to_array(header, '\s+')) <= 6 GROUP BY header""".replace("\\\\", "\\"))
def header_statistics(spark, d):
    return sections.header_counts(sections.header_lines(table(spark, d, "documents"), "doc_id", "text"))


@query("""SELECT gram, count(DISTINCT item_id) AS n FROM (SELECT item_id, unnest(flatten(list_transform([2, 3, 4], lambda n: CASE WHEN len(w) >= n THEN list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')) ELSE [] END))) AS gram
  FROM (SELECT item_id, """ + _words("lower(text)") + """ AS w FROM benchmark)) GROUP BY gram""")
def word_ngrams(spark, d):
    grams = table(spark, d, "benchmark").select("item_id", F.explode(T.ngrams(F.lower("text"))).alias("gram"))
    return grams.groupBy("gram").agg(F.countDistinct("item_id").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 1 WHEN contains(lower(text), 'license') THEN 2 ELSE 0 END AS label FROM documents")
def span_classes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.array(F.struct(F.col("lang").alias("label"))).alias("spans"))
    return docs.select("doc_id", T.span_class(F.col("text"), F.col("spans"), "en", "license").alias("label"))


_OUT = rf"""SELECT doc_id,
  CASE WHEN regexp_matches(text, '(?i)licensed\s+under') OR regexp_matches(text, '(?i)released\s+under') THEN 'licensed' WHEN regexp_matches(text, '(?i)rights\s+reserved') THEN 'reserved'
    WHEN {{the}} OR {{die}} THEN 'plain' WHEN {{la}} OR {{el}} THEN 'other' END AS outcome,
  CASE WHEN regexp_matches(text, '(?i)(licensed|released)\s+under|rights\s+reserved') THEN 0.9 WHEN {{the}} OR {{die}} OR {{la}} OR {{el}} THEN 0.6 ELSE 0.0 END AS confidence FROM documents"""


def _word(w: str) -> str:
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]){w}($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])')"


@query(_OUT.format(**{w: _word(w) for w in ("the", "die", "la", "el")}))
def outcomes(spark, d):
    docs = table(spark, d, "documents").select("doc_id", sections.outcome(F.col("text"), OUTCOME_PACK).alias("o"))
    return docs.select("doc_id", "o.outcome", "o.confidence")


# -- extractors --

_SCORED = rf"""s AS (SELECT doc_id, {_sentences('text')} AS s FROM documents),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM s),
  u AS (SELECT doc_id, sentence, min(n) AS n, min(pos) AS first, max(pos) AS last FROM e GROUP BY doc_id, sentence),
  c AS (SELECT *, sentence IN ('All rights reserved.', 'Of.') AS exact, CASE WHEN sentence IN ('All rights reserved.', 'Of.') THEN 20.0
    WHEN contains(lower(sentence), 'license') OR contains(lower(sentence), 'rights reserved') THEN 20.0 WHEN regexp_matches(sentence, '[0-9]{{2,}}') THEN 10.0
    WHEN regexp_matches(sentence, '(?i)(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])(of{_S}+the|de{_S}+la)($|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])') THEN 5.0
    ELSE {" + ".join(f"CAST({_bounded('lower(sentence)', k)} AS INT)" for k in ("the", "and", "die", "le"))}
      + CASE WHEN len({_words('sentence')}) BETWEEN 5 AND 30 THEN 0.5 WHEN len({_words('sentence')}) > 30 THEN -0.5 ELSE 0 END
      + CAST({" OR ".join(_bounded('lower(sentence)', k) for k in ("is", "ist", "est"))} AS INT) END AS score FROM u),
  r AS (SELECT *, CASE WHEN exact THEN last ELSE first END AS place, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, exact DESC, first) AS rank, max(score) OVER (PARTITION BY doc_id) AS best FROM c WHERE score > 0)"""


@query(f"""WITH {_SCORED}
  SELECT doc_id, md5(sentence) AS h, CAST(score AS DOUBLE) AS score, round(place / greatest(1, n - 1), 9) AS position, CASE WHEN exact THEN 'exact' ELSE 'pattern' END AS match_type, rank
  FROM r WHERE (best >= 10 AND score >= greatest(5, best * 0.7) AND rank <= 5) OR (best < 10 AND rank <= 3)""")
def basic_selection(spark, d):
    """The flagship: rule-scored sentences, ranked and capped in every document."""
    out = extract.basic(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", PACK)
    return out.select("doc_id", F.md5("text").alias("h"), "score", F.round("position", 9).alias("position"), "match_type", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {_SCORED} SELECT doc_id, count(*) AS n, sum(score) AS total FROM r GROUP BY doc_id""")
def basic_candidates(spark, d):
    out = extract.basic_candidates(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", PACK)
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total"))


def _bare(t: str) -> str:
    """Counterpart of functions.text._bare."""
    kept = _sub(_sub(_sub(t, rf"({_W})''({_W})", r"\1§\2"), rf"[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\t-\r \x{{85}}\x{{A0}}\x{{2028}}\x{{2029}}§]", " "), "§", "''")
    return _strip(_sub(kept, f"{_S}+", " "))


def _replaced(t: str, pairs: tuple[tuple[str, str], ...]) -> str:
    for old, new in pairs:
        t = f"replace({t}, '{old}', '{new}')"
    return t


def _lacks_letter(x: str) -> str:
    return f"regexp_full_match({x}, '\\p{{Nd}}+')"


_CUT = _sub(_sub("text", "[.!?]+", "\x01"), rf"\]{_S}+\[", "]\x01[")
_CLAUSE = rf"{_S}*[,;]{_S}*|{_S}+and{_S}+"
_CLEANED_CLAUSE = _sub(_strip(_sub(_strip("x"), r"^\[+|\]+$", "")), "^[''\"]|[''\"]$", "")
_CLEANED_CLAUSE = f"trim({_strip(_sub(_sub(_replaced(f'lower({_CLEANED_CLAUSE})', SPARSE_PACK.rewrites), rf'({_W})[.]({_W})', chr(92) + '1 ' + chr(92) + '2'), _S + '+', ' '))}, '.,;:')"


@query(rf"""WITH w AS (SELECT doc_id, list_filter(list_transform(string_split({_CUT}, chr(1)), lambda x: {_strip("x")}), lambda x: x <> '') AS w FROM documents),
  c AS (SELECT doc_id, list_filter(flatten(list_transform(w, lambda x: regexp_split_to_array(x, '{_CLAUSE}'))), lambda x: {_strip("x")} <> '' AND NOT {_lacks_letter("x")}) AS c FROM w),
  e AS (SELECT doc_id, len(c) AS n, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM c),
  k AS (SELECT *, {_CLEANED_CLAUSE} AS k FROM e)
  SELECT doc_id, x AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INT) AS rank, round(pos / greatest(1, n - 1), 9) AS position FROM k
  WHERE k IN ({", ".join(map(repr, SPARSE_PACK.phrases))}) OR ((starts_with(k, 'released') OR starts_with(k, 'licensed')) AND contains(k, 'license'))
    OR regexp_matches(k, '(?i)version{_S}+[0-9]+|(^|[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}])of{_S}+the{_S}+{_W}')""")
def sparse_extraction(spark, d):
    out = extract.sparse(texts(spark, d), ["doc_id"], "text", SPARSE_PACK)
    return out.select("doc_id", "text", "rank", F.round("position", 9).alias("position"))


NGRAM_PACK = R.NgramRules(direct=(r"\blicensed\s+under",), phrases=("rights reserved",), markers=("the", "la", "die"), long_openers=("LICENSED",), short_openers=("ALL RIGHTS",), threshold=0.65, stop_gram=80)


def _bank(spark, d):
    sentences = table(spark, d, "benchmark").select(F.explode(T.sentences(F.col("text"))).alias("text"))
    return extract.gram_bank(sentences, NGRAM_PACK)


_NGRAMS = "flatten(list_transform([2, 3, 4], lambda n: CASE WHEN len({0}) >= n THEN list_transform(range(1, len({0}) - n + 2), lambda i: array_to_string({0}[i:i + n - 1], ' ')) ELSE [] END))"
_GRAM_TEXT = lambda t: _bare(_replaced(f"lower({t})", R.NGRAM_REWRITES))


@query(f"""WITH bs AS (SELECT unnest({_sentences("text")}) AS t FROM benchmark UNION ALL SELECT 'rights reserved'),
  bank AS (SELECT DISTINCT k FROM (SELECT {_GRAM_TEXT("t")} AS k FROM bs WHERE length({_strip("t")}) > 3) WHERE len({_words("k")}) >= 2),
  grams AS (SELECT k, unnest(list_distinct({_NGRAMS.format("w")})) AS gram FROM (SELECT k, {_words("k")} AS w FROM bank)),
  idx AS (SELECT k, gram FROM grams QUALIFY count(*) OVER (PARTITION BY gram) <= 80),
  s AS (SELECT doc_id, {_sentences("text")} AS s FROM documents),
  e AS (SELECT doc_id, len(s) AS n, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS pos FROM s),
  f AS (SELECT *, max(CAST(starts_with(upper(t), 'LICENSED') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)
      + max(CAST(starts_with(upper(t), 'ALL RIGHTS') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) > 0 AS opened,
    regexp_matches(lower(t), '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}])licensed{_S}+under') AS direct, contains(lower(t), 'rights reserved') AS phrase,
    contains(lower(t), 'the') OR contains(lower(t), 'la') OR contains(lower(t), 'die') AS marker, {_GRAM_TEXT("t")} AS k FROM e),
  m AS (SELECT f.*, b.k IS NOT NULL AS known FROM f LEFT JOIN bank b ON f.k = b.k),
  o AS (SELECT DISTINCT k, {_words("k")} AS w FROM m WHERE NOT direct AND NOT phrase AND NOT known AND (opened OR marker) AND len({_words("k")}) >= 3),
  ways AS (SELECT o.k, b.k AS hit, least(length(o.k), length(b.k)) / greatest(length(o.k), length(b.k)) AS v, 1 AS way FROM o JOIN bank b
      ON length(b.k) BETWEEN length(o.k) * 0.6 AND length(o.k) * 1.4 AND (contains(o.k, b.k) OR contains(b.k, o.k))
    UNION ALL SELECT p.k, i.k, count(*) / p.total, 2 FROM (SELECT k, total, array_to_string(w[i:i + n - 1], ' ') AS gram FROM
        (SELECT k, w, n, 3 * len(w) - 6 AS total, unnest(range(1, len(w) - n + 2)) AS i FROM o, (VALUES (2), (3), (4)) v(n) WHERE len(w) >= n)) p JOIN idx i ON p.gram = i.gram GROUP BY p.k, i.k, p.total),
  best AS (SELECT k, hit, v FROM ways WHERE v >= 0.65 QUALIFY row_number() OVER (PARTITION BY k ORDER BY way, v DESC, hit) = 1),
  c AS (SELECT m.doc_id, m.t, m.pos, CASE WHEN direct THEN 'direct_pattern' WHEN phrase THEN 'phrase_match' WHEN known THEN 'exact' ELSE 'ngram' END AS kind,
    CASE WHEN direct THEN 20.0 WHEN phrase THEN 18.0 WHEN known THEN 20.0 ELSE v * 20 END AS score,
    CASE WHEN direct THEN m.t WHEN phrase THEN 'rights reserved' WHEN known THEN m.k ELSE hit END AS matched
    FROM m LEFT JOIN best ON m.k = best.k AND (opened OR marker) WHERE direct OR phrase OR known OR hit IS NOT NULL),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS rank FROM c),
  u AS (SELECT * FROM r WHERE kind <> 'ngram' OR score >= 15 QUALIFY row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY rank) = 1),
  y AS (SELECT *, count(*) FILTER (kind <> 'ngram') OVER (PARTITION BY doc_id) >= 3 AS many FROM u),
  z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN many AND kind = 'ngram' THEN 1 ELSE 0 END, rank) AS place FROM y WHERE NOT many OR kind <> 'ngram' OR score >= 17)
  SELECT doc_id, t AS text, matched AS matched_text, round(CAST(score AS DOUBLE), 6) AS score, kind AS match_type, CAST(place AS INT) AS rank FROM z WHERE place <= 6""")
def ngram_extraction(spark, d):
    """Benchmark sentences found again in documents."""
    out = extract.ngram(texts(spark, d), ["doc_id"], "text", _bank(spark, d), NGRAM_PACK)
    return out.select("doc_id", "text", "matched_text", F.round("score", 6).alias("score"), "match_type", "rank")


SECTION_PACK = R.HeaderRules(
    categories=(("license_headers", ("RIGHTS RESERVED", "LICENSED", "RELEASED")), ("short_headers", ("OF", "THE"))),
    gate=("RESERVED", "LICENSED", "RELEASED", "OF", "THE"),
    ahead=("LICENSED",),
    strict=True,
)


_NL = "chr(10)"
_META = [_p.replace(r"\s", _S).replace(r"(?=\n?\z)", "") + ("" if i == 0 else r"\n?$") for i, _p in enumerate(R.METADATA)]
_PAGES = [_p.replace(r"[A-Z0-9\-\s]", r"[A-Z0-9\-\t-\r \x{85}\x{A0}\x{2028}\x{2029}]").replace(r"\s", _S).replace(r"\d", r"\p{Nd}").replace(r"(?=\n?\z)", "$") for _p in R.PAGE_POINTERS]
_QUOTED = lambda p: p.replace("'", "''")
_FR_WORDS = f"len(list_filter({_words('lower(x)')}, lambda w: w IN ({', '.join(map(repr, R.FRENCH_WORDS))}))) > {R.FRENCH_SHARE} * len({_words('lower(x)')})"
_FR_LINE = f"len({_words('x')}) > 0 AND ({_FR_WORDS} OR regexp_matches(x, '(?i){_QUOTED('|'.join(R.FRENCH_PATTERNS)).replace(chr(92) + 's', _S)}'))"


def _paged(t: str) -> str:
    for p in _PAGES:
        t = _sub(t, p, "")
    return t


def _said(t: str) -> str:
    """Confidence and outcome of a text by OUTCOME_PACK."""
    word = lambda *ws: " OR ".join(_word(w).replace("(text,", f"({t},") for w in ws)
    patterns = f"regexp_matches({t}, '(?i)(licensed|released){_S}+under') OR regexp_matches({t}, '(?i)rights{_S}+reserved')"
    return f"""CASE WHEN regexp_matches({t}, '(?i)(licensed|released){_S}+under') THEN 'licensed' WHEN {patterns} THEN 'reserved' WHEN {word("the", "die")} THEN 'plain' WHEN {word("la", "el")} THEN 'other' END AS outcome,
    CASE WHEN {patterns} THEN 0.9 WHEN {word("the", "die", "la", "el")} THEN 0.6 ELSE 0.0 END AS confidence"""


def _header(x: str) -> str:
    """The category of a line that is a header by SECTION_PACK as a whole."""
    whole = lambda *terms: f"regexp_full_match(upper({x}), '{_S}*(\\p{{Nd}}+{_S}+)?(THE{_S}+)?({'|'.join(terms)}){_S}*[.:]?{_S}*(\\[\\p{{Nd}}+\\])?{_S}*')"
    return f"CASE WHEN {whole('RIGHTS RESERVED', 'LICENSED', 'RELEASED')} THEN 'license_headers' WHEN {whole('OF', 'THE')} THEN 'short_headers' END"


_BRIEF = "starts_with({0}, '[') OR length({0}) < 20"


@query(f"""WITH a AS (SELECT doc_id, text, coalesce({", ".join(f"nullif(regexp_extract(text, '{p}'), '')" for p in _META)}) AS meta FROM documents WHERE {_strip("text")} <> ''),
  b AS (SELECT doc_id, {_paged(_strip("CASE WHEN meta IS NULL THEN text ELSE substr(text, 1, instr(text, meta) - 1) || substr(text, instr(text, meta) + length(meta)) END"))} AS t FROM a),
  c AS (SELECT doc_id, replace(regexp_replace(array_to_string(list_filter(string_split(t, {_NL}), lambda x: NOT ({_FR_LINE})), {_NL}), 'X{{3,}}', '[REDACTED]', 'g'), '[REDACTION]', '[REDACTED]') AS t FROM b),
  l AS (SELECT doc_id, {_strip(f"array_to_string(list_transform(string_split({_sub(_sub('t', ' +', ' '), chr(92) + 'n+', chr(10) + chr(10))}, {_NL}), lambda x: {_strip('x')}), {_NL})")} AS t FROM c),
  q AS (SELECT doc_id, t, string_split(t, {_NL}) AS lines FROM l),
  i AS (SELECT doc_id, lines, len(lines) AS n, unnest(range(0, len(lines))) AS i FROM q),
  j AS (SELECT doc_id, i, n, {_strip("lines[i + 1]")} AS x, {_strip("coalesce(lines[i + 2], '')")} AS y, {_strip("coalesce(lines[i + 3], '')")} AS z FROM i),
  k AS (SELECT doc_id, i, x, CASE WHEN i < n - 2 AND contains(upper(x), 'LICENSED') AND ({_BRIEF.format("y")}) THEN x || {_NL} || y END AS xy,
    CASE WHEN i < n - 3 AND contains(upper(x), 'LICENSED') AND ({_BRIEF.format("y")}) AND ({_BRIEF.format("z")}) THEN x || {_NL} || y || {_NL} || z END AS xyz FROM j WHERE x <> ''),
  g AS (SELECT doc_id, i, CASE WHEN {_header("xy")} IS NOT NULL THEN xy WHEN {_header("xyz")} IS NOT NULL THEN xyz ELSE x END AS header, coalesce({_header("xy")}, {_header("xyz")}, {_header("x")}) AS category FROM k),
  h AS (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM g WHERE category IS NOT NULL),
  s AS (SELECT h.doc_id, i, category, header, {_strip(f"array_to_string(lines[i + 2:coalesce(nxt, len(lines))], {_NL})")} AS content FROM h JOIN q USING (doc_id) WHERE i + 1 < coalesce(nxt, len(lines))),
  o AS (SELECT doc_id, category, header, min(i) AS i, arg_max(content, i) AS content FROM s GROUP BY doc_id, category, header),
  v AS (SELECT doc_id, category, i, {_said("content")} FROM o),
  d AS (SELECT doc_id, arg_min(outcome, (CASE WHEN category = 'license_headers' THEN 0 ELSE 1 END, i)) AS outcome,
      arg_min(outcome, i) FILTER (category = 'license_headers') AS a, arg_min(confidence, i) FILTER (category = 'license_headers') AS ac,
      arg_min(outcome, i) FILTER (category = 'short_headers') AS b, arg_min(confidence, i) FILTER (category = 'short_headers') AS bc FROM v WHERE confidence > 0.5 GROUP BY doc_id)
  SELECT doc_id, (SELECT count(*) FROM h WHERE h.doc_id = documents.doc_id) AS headers, (SELECT count(*) FROM o WHERE o.doc_id = documents.doc_id) AS sections, md5(coalesce(l.t, '')) AS cleaned,
    md5(coalesce((SELECT string_agg(category || chr(1) || header || chr(1) || content, chr(2) ORDER BY i) FROM o WHERE o.doc_id = documents.doc_id), '')) AS contents,
    CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.doc_id = documents.doc_id AND category = 'license_headers') THEN true END AS has_license_headers,
    CASE WHEN d.a IS NULL THEN d.b WHEN d.ac < 0.7 AND d.bc > d.ac THEN d.b ELSE d.a END AS decision_outcome
  FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN d USING (doc_id)""")
def document_sections(spark, d):
    docs = texts(spark, d).withColumnRenamed("text", "full_text")
    out = sections.preprocess(docs, "full_text", SECTION_PACK, OUTCOME_PACK, ("license_headers", "short_headers"))
    contents = F.array_join(F.transform("sections", lambda s: F.concat_ws("\x01", s["category"], s["header"], s["content"])), "\x02")
    return out.select("doc_id", F.size("headers").cast("bigint").alias("headers"), F.size("sections").cast("bigint").alias("sections"), F.md5("cleaned_text").alias("cleaned"), F.md5(contents).alias("contents"), "has_license_headers", "decision_outcome")


_PARTED = f"string_split(regexp_replace(text, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1))"
_AFTER = "array_to_string(s[{0} + 1:{1} + 1], ' ')"


@query(f"""WITH p AS (SELECT doc_id, {_PARTED} AS s FROM documents),
  m AS (SELECT doc_id, s, list_filter(range(0, len(s)), lambda i: contains(s[i + 1], 'the')) AS pl FROM p),
  f AS (SELECT *, CASE WHEN pl[1] < 50 THEN pl[1] END AS first, len(pl) AS k FROM m),
  g AS (SELECT *, s[first + 1] AS line, instr(s[first + 1], 'the') AS cut FROM f),
  b AS (SELECT *, {_strip("substr(line, 1, cut - 1)")} AS before, CASE WHEN k >= 2 THEN {_strip(_AFTER.format("(pl[k - 1] + 1)", "pl[k]"))} END AS one, CASE WHEN k >= 3 THEN {_strip(_AFTER.format("(pl[k - 2] + 1)", "pl[k]"))} END AS two FROM g)
  SELECT doc_id, CASE WHEN first IS NOT NULL THEN {_strip("array_to_string(list_concat(s[1:first], CASE WHEN before <> '' THEN [before] ELSE [] END), ' ')")} END AS general_metadata,
    CASE WHEN first IS NOT NULL THEN {_strip(f"{_strip('substr(line, cut)')} || ' ' || {_strip(_AFTER.format('(first + 1)', '(first + 7)'))}")} END AS suspected_first_case_paragraph,
    CASE WHEN length(one) >= 100 THEN one WHEN length(two) >= 100 THEN two END AS suspected_last_case_paragraph FROM b""")
def marker_paragraphs(spark, d):
    docs = texts(spark, d).select("doc_id", sections.marker_paragraphs(F.col("text"), "the", least=100).alias("m"))
    return docs.select("doc_id", "m.*")


# -- evaluation --

_PRED = "CAST((doc_id * 7919 % 1000) / 1000.0 AS DOUBLE)"


def _scored(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return labels.withColumn("prob", (F.col("doc_id") * 7919 % 1000) / 1000.0)


def _votes(spark, d):
    """Five models' votes on every labelled document, from hashes of the id."""
    models = F.explode(F.array(*[F.struct(F.lit(f"m{i}").alias("model"), ((F.col("doc_id") * p % 1000) / 1000.0).alias("prob")) for i, p in enumerate((7919, 104_729, 1_299_709, 611_953, 15_485_863))])).alias("v")
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"), models)
    return rows.select("doc_id", "label", "v.model", "v.prob").withColumn("pred", (F.col("prob") > 0.3).cast("int"))


_VOTES = """votes AS (SELECT doc_id, quality AS label, 'm' || i AS model, (doc_id * p % 1000) / 1000.0 AS prob, CAST((doc_id * p % 1000) / 1000.0 > 0.3 AS INT) AS pred
  FROM labels, (VALUES (0, 7919), (1, 104729), (2, 1299709), (3, 611953), (4, 15485863)) m(i, p))"""
_RATES = """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 4) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1"""
_COUNTS = "count(*) FILTER (label = 1 AND pred = 1) AS tp, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 0 AND pred = 0) AS tn"


@query(f"WITH {_VOTES} SELECT model, {_RATES} FROM (SELECT model, {_COUNTS} FROM votes GROUP BY model)")
def confusion_metrics(spark, d):
    return evaluate.rounded(evaluate.confusion(_votes(spark, d), ["model"]))


@query(f"""SELECT t AS threshold, {_RATES} FROM (SELECT t, {_COUNTS} FROM (SELECT CAST(round(0.2 + 0.01 * i, 2) AS DOUBLE) AS t, quality AS label, CAST({_PRED} > round(0.2 + 0.01 * i, 2) AS INT) AS pred FROM labels, range(30) r(i)) GROUP BY t)""")
def threshold_sweep(spark, d):
    return evaluate.rounded(evaluate.sweep(_scored(spark, d), evaluate.SWEEP))


@query(f"""SELECT t AS threshold, {_RATES} FROM (SELECT t, {_COUNTS} FROM (SELECT CAST(round(0.2 + 0.01 * i, 2) AS DOUBLE) AS t, quality AS label, CAST({_PRED} > round(0.2 + 0.01 * i, 2) AS INT) AS pred FROM labels, range(30) r(i)) GROUP BY t)
  WHERE coalesce(tp / nullif(tp + fp, 0), 0) >= 0.5 ORDER BY coalesce(tp / nullif(tp + fn, 0), 0) DESC, t LIMIT 1""")
def recall_threshold(spark, d):
    return evaluate.rounded(evaluate.best_threshold(evaluate.sweep(_scored(spark, d), evaluate.SWEEP), "recall", 0.5))


@query(f"WITH {_VOTES} SELECT doc_id, model, CASE WHEN pred = 1 THEN 'FP' ELSE 'FN' END AS error_type FROM votes WHERE pred <> label")
def mispredictions(spark, d):
    return evaluate.mispredictions(_votes(spark, d)).select("doc_id", "model", "error_type")


@query(f"WITH {_VOTES} SELECT count(*) FILTER (pred = 1 AND label = 0) AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn, round(count(*) FILTER (pred = 1 AND label = 0) * 100.0 / count(*), 6) AS fp_pct, round(count(*) FILTER (pred = 0 AND label = 1) * 100.0 / count(*), 6) AS fn_pct FROM votes")
def error_shares(spark, d):
    return evaluate.error_shares(_votes(spark, d)).withColumns({c: F.round(c, 6) for c in ("fp_pct", "fn_pct")})


def _cases(spark, d):
    c = table(spark, d, "conversations")
    cases = c.groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("determination_count"))
    return cases, c.where("role = 'assistant'").select("conv_id", "text"), c.where("role = 'user'").select("conv_id", "text")


_CASES = """c AS (SELECT conv_id, count(*) FILTER (role = 'user') AS expected_count, count(*) FILTER (role = 'assistant') AS extracted_count FROM conversations GROUP BY conv_id),
  m AS (SELECT *, extracted_count / greatest(1, expected_count) AS count_ratio FROM c)"""


@query(f"WITH {_CASES} SELECT conv_id, extracted_count, expected_count, round(count_ratio, 9) AS count_ratio FROM m")
def case_metrics(spark, d):
    cases, found, _ = _cases(spark, d)
    return evaluate.case_metrics(cases, found, "conv_id").withColumn("count_ratio", F.round("count_ratio", 9))


@query(f"""WITH {_CASES} SELECT round(avg(extracted_count), 9) AS avg_extracted_count, round(avg(expected_count), 9) AS avg_expected_count, round(avg(count_ratio), 9) AS avg_count_ratio,
  count(*) FILTER (count_ratio >= 1) AS cases_meeting_expected, count(*) AS total_cases, round(count(*) FILTER (count_ratio >= 1) / count(*), 9) AS pct_meeting_expected FROM m""")
def case_summary(spark, d):
    cases, found, _ = _cases(spark, d)
    out = evaluate.case_summary(evaluate.case_metrics(cases, found, "conv_id"))
    return out.withColumns({c: F.round(c, 9) for c in ("avg_extracted_count", "avg_expected_count", "avg_count_ratio", "pct_meeting_expected")})


@query(f"""WITH {_CASES}, top AS (SELECT *, expected_count - extracted_count AS gap FROM m WHERE expected_count > 1 AND count_ratio < 1 ORDER BY gap DESC, conv_id LIMIT 20),
  lone AS (SELECT conv_id, count(*) AS missing FROM conversations e WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM conversations f WHERE f.conv_id = e.conv_id AND f.role = 'assistant'
    AND (contains(lower(trim(e.text)), lower(trim(f.text))) OR contains(lower(trim(f.text)), lower(trim(e.text))))) GROUP BY conv_id)
  SELECT conv_id, gap, coalesce(missing, 0) AS missing FROM top LEFT JOIN lone USING (conv_id)""")
def under_extracted(spark, d):
    cases, found, expected = _cases(spark, d)
    texts = expected.groupBy("conv_id").agg(F.min("text").alias("full_text"))
    out = evaluate.under_extracted(evaluate.case_metrics(cases, found, "conv_id"), expected, found, texts, "conv_id", ratio=1.0)
    return out.select("conv_id", "gap", F.size("missing").cast("bigint").alias("missing"))


@query(f"""WITH c AS (SELECT conv_id, count(*) FILTER (role = 'system') + 1 AS expected_count, count(*) FILTER (role <> 'system') AS extracted_count FROM conversations GROUP BY conv_id)
  SELECT conv_id, extracted_count - expected_count AS gap FROM c WHERE extracted_count > expected_count + 2 ORDER BY gap DESC, conv_id LIMIT 20""")
def over_extracted(spark, d):
    c = table(spark, d, "conversations")
    cases = c.groupBy("conv_id").agg((F.count_if(F.col("role") == "system") + 1).alias("determination_count"))
    found, expected = c.where("role <> 'system'").select("conv_id", "text"), c.where("role = 'system'").select("conv_id", "text")
    texts = c.groupBy("conv_id").agg(F.min("text").alias("full_text"))
    return evaluate.over_extracted(evaluate.case_metrics(cases, found, "conv_id"), expected, found, texts, "conv_id").select("conv_id", "gap")


@query(f"WITH {_VOTES} SELECT doc_id, round(avg(pred), 9) AS share, max(label) AS label, CAST(avg(pred) >= 0.667 AS INT) AS pred FROM votes GROUP BY doc_id")
def majority_vote(spark, d):
    return evaluate.majority(_votes(spark, d), "doc_id").withColumn("share", F.round("share", 9))


@query(f"""WITH {_VOTES}, s AS (SELECT doc_id, avg(pred) AS share, max(label) AS label FROM votes GROUP BY doc_id)
  SELECT threshold, {_RATES} FROM (SELECT threshold, {_COUNTS} FROM (SELECT CAST(t AS DOUBLE) AS threshold, label, CAST(share >= t AS INT) AS pred FROM s, (VALUES (0.5), (0.6), (0.667), (0.75)) v(t)) GROUP BY threshold)""")
def vote_thresholds(spark, d):
    return evaluate.rounded(evaluate.vote_sweep(_votes(spark, d), "doc_id"))


@query(f"""WITH {_VOTES} SELECT a.model AS m1, b.model AS m2, count(*) FILTER (a.pred <> a.label AND b.pred <> b.label) AS both, count(*) FILTER (a.pred <> a.label AND b.pred = b.label) AS only1,
  count(*) FILTER (a.pred = a.label AND b.pred <> b.label) AS only2, count(*) FILTER (a.pred <> a.label) AS total1, count(*) FILTER (b.pred <> b.label) AS total2
  FROM votes a JOIN votes b ON a.doc_id = b.doc_id AND a.model < b.model GROUP BY 1, 2""")
def error_overlap(spark, d):
    return evaluate.error_overlap(_votes(spark, d), "doc_id")


@query(f"""WITH {_VOTES} SELECT doc_id, max(label) AS label, max(pred) FILTER (model = 'm0') AS m0_pred, max(pred) FILTER (model = 'm1') AS m1_pred,
  CAST(count(*) FILTER (model IN ('m0', 'm1') AND pred <> label) AS INT) AS errors FROM votes GROUP BY doc_id""")
def wide_votes(spark, d):
    return evaluate.wide_votes(_votes(spark, d), "doc_id", ["m0", "m1"]).select("doc_id", "label", "m0_pred", "m1_pred", "errors")


@query(f"""WITH {_VOTES}, w AS (SELECT doc_id, max(label) AS label, max(pred) FILTER (model = 'm0') AS a, max(pred) FILTER (model = 'm1') AS b FROM votes GROUP BY doc_id)
  SELECT CASE WHEN a = label AND b = label THEN 'both_correct' WHEN a = label THEN 'only_m0_pred' WHEN b = label THEN 'only_m1_pred' ELSE 'both_wrong' END AS status, count(*) AS n FROM w GROUP BY 1""")
def ensemble_agreement(spark, d):
    wide = evaluate.wide_votes(_votes(spark, d), "doc_id", ["m0", "m1"])
    return evaluate.agreement(wide, "m0_pred", "m1_pred").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


# -- datasets --


@query("""SELECT doc_id, lang, n_chars FROM documents WHERE (doc_id % 2 = 0 AND n_chars >= 1000) OR (doc_id % 2 = 1 AND n_chars >= 0)""")
def validation_set(spark, d):
    docs = table(spark, d, "documents")
    return datasets.validation_set(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["doc_id", "lang", "n_chars", "absent"], "n_chars", 1000, 0)


def _silver(spark, d):
    docs = extract.basic(table(spark, d, "documents").select("doc_id", F.lit("s").alias("section"), "text"), ["doc_id", "section"], "text", PACK)
    rows = docs.select("doc_id", F.when(F.col("rank") == 1, "sparse_explicit_extraction").otherwise("reasons_basic_extraction").alias("column"), F.col("rank").alias("place"), "text")
    return datasets.silver_positives(rows, "doc_id", keywords=("of", "the", "la"))


def re2(pattern: str) -> str:
    """A pattern with Unicode classes in RE2's words, quotes doubled for SQL."""
    words, blanks, digits = r"\p{L}\p{M}\p{Nd}\p{Pc}", r"\t-\r \x{85}\x{A0}\x{2028}\x{2029}", r"\p{Nd}"
    out, inside, i = "", False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\w", r"\s", r"\d"):
            named = {r"\w": words, r"\s": blanks, r"\d": digits}[two]
            out, i = out + (named if inside else f"[{named}]"), i + 2
        elif two[0] == "\\":
            out, i = out + two, i + 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out, i = out + two[0], i + 1
    return out.replace("'", "''")


def chained(t: str, pairs) -> str:
    for pattern, to in pairs:
        t = f"regexp_replace({t}, '(?i){re2(pattern)}', '{to}', 'g')"
    return t


def _numbers_out(t: str) -> str:
    """Counterpart of the look-behind for numbers: digits beside a letter are set aside, the others go, and they come back."""
    for k in range(10):
        t = _sub(_sub(t, f"([a-zA-Z]){k}", f"\\1{chr(0xE000 + k)}"), f"{k}([a-zA-Z])", f"{chr(0xE000 + k)}\\1")
    return f"translate({_sub(t, re2(chr(92) + 'd+(?:' + chr(92) + 's*-' + chr(92) + 's*' + chr(92) + 'd+)*'), '')}, '{''.join(chr(0xE000 + k) for k in range(10))}', '0123456789')"


_TRAINED = _sub(chained(r"replace(replace(t, '\n', ' '), '\r', ' ')", ((p, "") for p in R.DOCUMENT_IDS)), f"{_S}+", " ")
_TRAINED = _sub(_sub(_TRAINED, re2(r"\[\d+\]"), ""), re2(rf"\d{{1,2}}\s+(?:{R.MONTHS})\s+\d{{4}}"), "")
_PARTS = ("t1", _sub(_sub("t0", r"\[.*?\]", ""), r"\(.*?\)", "")), ("t2", _sub(_sub("t1", re2(r"^[-\\/\s]+"), ""), re2(r"[-\\/\s]+$"), "")), ("t3", f"rtrim({_sub(_sub('t2', _S + '+[.]', '.'), '[.]' + _S + '*', '. ')}, '. ')"), ("t4", _strip("CASE WHEN t3 = '' THEN t3 ELSE t3 || '.' END"))
_JUDGED = f"""{_SCORED}, k0 AS (SELECT doc_id, rank AS place, rank = 1 AS sure, sentence AS t FROM r WHERE (best >= 10 AND score >= greatest(5, best * 0.7) AND rank <= 5) OR (best < 10 AND rank <= 3)),
  k1 AS (SELECT doc_id, place, sure, {_TRAINED} AS n FROM k0), k2 AS (SELECT doc_id, place, sure, {_numbers_out("n")} AS t0 FROM k1)"""
for _i, (_name, _expression) in enumerate(_PARTS, 3):
    _JUDGED += f",\n  k{_i} AS (SELECT doc_id, place, sure, {_expression} AS {_name} FROM k{_i - 1})"
_JUDGED += f""",
  k7 AS (SELECT doc_id, place, sure, CASE WHEN length(t4) < 5 OR regexp_full_match(t4, '{re2(r"[" + chr(92) + "d" + chr(92) + "s" + chr(92) + "-" + chr(92) * 2 + "/" + chr(92) + ".]+")}') THEN '' ELSE t4 END AS cleaned FROM k6),
  k8 AS (SELECT *, CASE WHEN length(cleaned) > 200 THEN 'too_long' WHEN NOT sure AND NOT regexp_matches(lower(cleaned), 'of|the|la') THEN 'no_keyword' WHEN cleaned = '' THEN 'empty' ELSE 'accepted' END AS s0 FROM k7),
  judged AS (SELECT *, CASE WHEN s0 = 'accepted' AND row_number() OVER (PARTITION BY lower(trim(cleaned)), s0 ORDER BY NOT sure, doc_id, place) > 1 THEN 'duplicate' ELSE s0 END AS status FROM k8)"""


@query(f"WITH {_JUDGED} SELECT cleaned AS text, 1 AS label FROM judged WHERE status = 'accepted'")
def silver_set(spark, d):
    return datasets.silver_set(_silver(spark, d))


@query(f"""WITH {_JUDGED} SELECT CASE WHEN sure THEN 'sparse_explicit_extraction' ELSE 'reasons_basic_extraction' END AS "column",
  {", ".join(f"count(*) FILTER (status = '{n}') AS {n}" for n in ("accepted", "duplicate", "empty", "too_long", "no_keyword"))} FROM judged GROUP BY sure""")
def silver_statistics(spark, d):
    return datasets.silver_statistics(_silver(spark, d))


def _annotated(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    return docs.join(labels, "doc_id").select("text", (F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 0).otherwise(2)).alias("label"))


@query("""WITH a AS (SELECT text, CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 0 ELSE 2 END AS label FROM documents JOIN labels USING (doc_id)),
  n AS (SELECT count(*) FILTER (label = 1) AS ones, count(*) FILTER (label = 2) AS twos, CAST(floor(count(*) FILTER (label = 2) * 0.9) AS BIGINT) AS kept FROM a),
  r AS (SELECT label, text, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || text || '|0'), text) AS r FROM a WHERE label <> 1),
  z AS (SELECT text FROM r, n WHERE label = 0 AND r <= ones - (twos - kept)),
  train AS (SELECT text, 0 AS label FROM a WHERE label = 0 AND text NOT IN (SELECT text FROM z) UNION ALL SELECT text, 0 FROM r, n WHERE label = 2 AND r <= kept UNION ALL SELECT 'a silver sentence.', 1),
  test AS (SELECT text, 1 AS label FROM a WHERE label = 1 UNION ALL SELECT text, 0 FROM z UNION ALL SELECT text, 0 FROM r, n WHERE label = 2 AND r > kept)
  SELECT 'train' AS split, label, text FROM train UNION ALL SELECT 'test', label, text FROM test""")
def train_test_split(spark, d):
    silver = spark.createDataFrame([("a silver sentence.", 1)], "text string, label int")
    train, test = datasets.train_test(_annotated(spark, d), silver)
    return train.select(F.lit("train").alias("split"), "label", "text").unionByName(test.select(F.lit("test").alias("split"), "label", "text"))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('42|' || doc_id), 1, 8) AS BIGINT) < CAST(floor(0.85 * 4294967296) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM documents")
def random_split(spark, d):
    train, test = datasets.random_split(table(spark, d, "documents").select("doc_id"), "doc_id")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


_DICE = "CAST('0x' || substr(md5('42|{0}|' || item_id), 1, 8) AS BIGINT)"


@query(f"""WITH w AS (SELECT item_id, text, {_words("text")} AS w FROM benchmark),
  d AS (SELECT *, CASE WHEN {_DICE.format(1)} / 4294967296.0 < 0.15 THEN list_filter(w, lambda x, i: i <> {_DICE.format(2)} % len(w) + 1) ELSE w END AS v FROM w),
  p AS (SELECT *, {_DICE.format(4)} % len(v) + 1 AS a FROM d),
  q AS (SELECT *, (a - 1 + {_DICE.format(5)} % (len(v) - 1) + 1) % len(v) + 1 AS b FROM p)
  SELECT item_id, CASE WHEN len(w) <= 3 THEN text ELSE array_to_string(CASE WHEN {_DICE.format(3)} / 4294967296.0 < 0.1 THEN list_transform(v, lambda x, i: CASE WHEN i = a THEN v[b] WHEN i = b THEN v[a] ELSE x END) ELSE v END, ' ') END AS text FROM q""")
def augmented(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.augment(F.col("text"), F.col("item_id")).alias("text"))
