"""Driver queries over sources and sinks, and over text functions: tables go out through a sink and come back."""

from __future__ import annotations

import io
import tarfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.operators import aggregates, datasets, enrich, evaluate, extract, keys, sections
from docloom.plans import driver, experiments, staged
from docloom.plans.driver import _S, _SCORED, _W, _bare, _strip, _sub, _words, chained, query, table
from docloom.sources import files, sheets, sinks
from docloom.sources.sinks import scratch


LANGUAGES = ("en", "de", "fr", "es")
_DOCS = "SELECT doc_id, lang, source, n_chars, md5(text) AS h FROM documents"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", "text")


def _hashed(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "source", F.col("n_chars").cast("bigint").alias("n_chars"), F.md5("text").alias("h"))


@query(_DOCS)
def csv_round_trip(spark, d):
    """Texts with line ends and quotes through CSV; the delimiter is found from the header."""
    return _hashed(files.read_csv(spark, sinks.write_csv(_docs(spark, d), f"{scratch(spark)}/docs"), multiline=True))


@query(_DOCS)
def csv_quoted(spark, d):
    return _hashed(files.read_csv(spark, sinks.write_csv(_docs(spark, d), f"{scratch(spark)}/docs", quote_all=True, escape='"'), ",", escape='"', multiline=True))


@query(_DOCS)
def jsonl_round_trip(spark, d):
    return _hashed(files.read_jsonl(spark, sinks.write_jsonl(_docs(spark, d), f"{scratch(spark)}/docs")))


@query(_DOCS)
def json_array_round_trip(spark, d):
    return _hashed(files.read_json_array(spark, sinks.write_json_array(_docs(spark, d), f"{scratch(spark)}/docs")))


@query(_DOCS)
def table_set(spark, d):
    """Parquet tables by name, of which one is absent, partitioned by language."""
    at = scratch(spark)
    sinks.write_table(_docs(spark, d), f"{at}/documents", ("lang",))
    found = files.load_tables(spark, at, ["documents", "absent"])
    assert list(found) == ["documents"]
    return _hashed(found["documents"])


@query("SELECT conv_id, count(*) AS n, md5(to_json(list(turn ORDER BY turn))) AS turns FROM conversations GROUP BY conv_id")
def nested_csv(spark, d):
    """A list column is kept as JSON text in CSV."""
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.count(F.lit(1)).alias("n"))
    out = files.read_csv(spark, sinks.write_csv(lists, f"{scratch(spark)}/lists"), ",")
    return out.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("n").cast("bigint").alias("n"), F.md5("turns").alias("turns"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS s_nationkey FROM supplier")
def sheet_round_trip(spark, d):
    return sheets.read_sheets(spark, sheets.write_sheet(table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), f"{scratch(spark)}/s.xlsx"))


@query("SELECT source FROM documents")
def single_column(spark, d):
    return files.read_column(spark, sinks.write_csv(_docs(spark, d), f"{scratch(spark)}/docs"), "source", multiline=True)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN o_orderpriority || ';more' ELSE o_orderpriority END AS note FROM orders""")
def ragged_lines(spark, d):
    """Lines with a field too few or too many."""
    o = table(spark, d, "orders")
    fields = [F.col("o_orderkey").cast("string"), F.col("o_orderstatus")]
    note = F.when(F.col("o_orderkey") % 3 == 1, F.concat("o_orderpriority", F.lit(";more"))).when(F.col("o_orderkey") % 3 == 2, F.col("o_orderpriority"))
    # a header in every part, and no quotes
    at = f"{scratch(spark)}/ragged"
    o.select(F.concat_ws(";", *fields, note).alias("id;status;note")).write.option("header", True).option("sep", "\x01").option("quote", "\0").csv(at)
    return files.read_ragged(spark, at, ";")


@query("""SELECT 'customer.csv' AS name, count(*) AS n, CAST(sum(CASE WHEN c_custkey % 7 = 0 THEN -1 ELSE c_custkey END) AS BIGINT) AS ids FROM customer
  UNION ALL SELECT 'supplier.csv', count(*), CAST(sum(s_suppkey) AS BIGINT) FROM supplier""")
def folder_of_sources(spark, d):
    """Every CSV of a folder, with safe ids."""
    at = scratch(spark)
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey")).alias("id"), "c_name")
    sinks.write_csv(c, f"{at}/customer.csv")
    sinks.write_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), f"{at}/supplier.csv")
    sinks.write_jsonl(c, f"{at}/other.json")
    out = None
    for name, df in files.load_folder(spark, at, "id").items():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(F.lit(name).alias("name"), "n", "ids")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT '2020' AS year, CAST(n_nationkey AS VARCHAR) AS "decisionID", n_name AS full_text FROM nation""")
def case_files(spark, d):
    """Text files whose names fit; one whose name doesn't is left out."""
    at = scratch(spark)
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").collect()
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name, text in [*((f"2020canlii{r.n_nationkey}.txt", r.n_name) for r in rows), ("notes.txt", "not a case")]:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"))
        out.write(bytearray(text.encode()))
        out.close()
    return files.read_cases(spark, at)


@query("SELECT 'train' AS split, doc_id, CAST(quality AS BIGINT) AS label FROM labels WHERE doc_id % 5 <> 0 UNION ALL SELECT 'test', doc_id, CAST(quality AS BIGINT) FROM labels WHERE doc_id % 5 = 0")
def stored_split(spark, d):
    """Train and test tables, with checked labels."""
    at = scratch(spark)
    rows = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("text"), F.col("quality").alias("label"))
    sinks.write_table(rows.where("text % 5 <> 0"), f"{at}/train")
    sinks.write_table(rows.where("text % 5 = 0"), f"{at}/test")
    named = lambda n, df: files.labelled(df).select(F.lit(n).alias("split"), F.col("text").cast("bigint").alias("doc_id"), F.col("label").cast("bigint").alias("label"))
    train, test = files.load_split(spark, at)
    return named("train", train).unionByName(named("test", test))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 3")
def latest_stage(spark, d):
    """The last of several stages by name."""
    at, nation = scratch(spark), table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    for k in (1, 3, 2):
        sinks.write_table(nation.where(F.col("n_regionkey") == k).drop("n_regionkey"), f"{at}/stage_20240{k}01")
    sinks.write_table(nation, f"{at}/zone")
    return spark.read.parquet(files.latest(spark, at, "stage_"))


@query("""SELECT 'model' AS key, 'basic' AS value UNION ALL SELECT 'limits.least', '5' UNION ALL SELECT 'limits.most', (SELECT CAST(count(*) AS VARCHAR) FROM region) UNION ALL SELECT 'extra', 'true'""")
def configuration(spark, d):
    """A run's configuration over the defaults."""
    given = {"limits": {"most": table(spark, d, "region").count()}, "extra": True}
    at = sinks.write_report(spark, given, f"{scratch(spark)}/config.json")
    found = files.load_config(spark, at, {"model": "basic", "limits": {"least": 5, "most": 1}})
    rows = [("model", found["model"]), ("limits.least", str(found["limits"]["least"])), ("limits.most", str(found["limits"]["most"])), ("extra", str(found["extra"]).lower())]
    return spark.createDataFrame(rows, "key string, value string")


@query("""SELECT 'rows' AS what, count(*) AS n, NULL AS type FROM supplier UNION ALL SELECT 's_suppkey', (SELECT count(*) FROM supplier), 'number'
  UNION ALL SELECT 's_name', (SELECT count(*) FROM supplier), 'string' UNION ALL SELECT 's_acctbal', (SELECT count(*) FROM supplier), 'number'""")
def file_profiles(spark, d):
    """Rows of a CSV, and keys with types of JSON records."""
    rows, at = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal").coalesce(1), scratch(spark)
    n = files.row_count(spark, sinks.write_csv(rows, f"{at}/s"))
    kinds = files.jsonl_profile(spark, sinks.write_jsonl(rows, f"{at}/j"))
    counted = spark.createDataFrame([("rows", n, None)], "what string, n bigint, type string")
    return counted.unionByName(kinds.select(F.col("key").alias("what"), F.col("records").cast("bigint").alias("n"), "type"))


# -- keys, lists, enrichment --


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS number FROM events")
def numeric_coercion(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id"))).otherwise(F.col("value").cast("string"))
    return table(spark, d, "events").select("event_id", keys.to_number(raw).alias("number"))


@query("SELECT user_id, CAST(count(*) FILTER (value >= 50) AS INT) AS n, round(coalesce(sum(value) FILTER (value >= 50), 0), 4) AS total FROM events GROUP BY user_id")
def keep_scored(spark, d):
    lists = table(spark, d, "events").groupBy("user_id").agg(F.collect_list(F.struct("event_id", F.col("value").alias("score"))).alias("hits"))
    kept = lists.select("user_id", keys.keep_scored(F.col("hits"), 50.0).alias("hits"))
    return kept.select("user_id", F.size("hits").alias("n"), F.round(F.aggregate("hits", F.lit(0.0), lambda s, x: s + x["score"]), 4).alias("total"))


@query("""WITH l AS (SELECT * FROM labels QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY quality, toxic) = 1)
  SELECT d.doc_id, d.n_chars % 2 AS quality, l.quality AS quality_estimated, l.toxic FROM documents d LEFT JOIN l USING (doc_id)""")
def suffix_resolution(spark, d):
    """The rows of the base stay as many; a clash of names gets a suffix."""
    base = table(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).alias("quality"))
    return enrich.left_unique(base, table(spark, d, "labels"), "doc_id", [F.col("quality"), F.col("toxic")])


@query("SELECT count(*) AS rows, count(CASE WHEN n_chars > 500 THEN lang END) AS lang, count(CASE WHEN n_chars > 5000 THEN source END) AS source FROM documents")
def presence_counters(spark, d):
    docs = table(spark, d, "documents").select(F.when(F.col("n_chars") > 500, F.col("lang")).alias("lang"), F.when(F.col("n_chars") > 5000, F.col("source")).alias("source"))
    return aggregates.presence(docs, ["lang", "source"])


@query("SELECT l_shipmode, round(avg(q), 6) AS avg_quantity, round(avg(p), 4) AS avg_price FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity AS q, l_extendedprice AS p FROM lineitem) GROUP BY 1")
def experiment_means(spark, d):
    rows = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("l_shipmode"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    out = aggregates.metric_means(rows, ["l_shipmode"], ["quantity", "price"])
    return out.select("l_shipmode", F.round("avg_quantity", 6).alias("avg_quantity"), F.round("avg_price", 4).alias("avg_price"))


@query(f"SELECT doc_id, CAST(len({_words('text')}) AS INT) AS n_words FROM documents")
def length_order(spark, d):
    return datasets.by_length(table(spark, d, "documents"), "text").select("doc_id", "n_words")


@query("""SELECT doc_id, section, md5(text) AS h FROM (SELECT doc_id, lang AS section, text FROM documents WHERE lang IN ('en', 'de', 'fr', 'es') UNION ALL SELECT doc_id, 'source', source FROM documents WHERE n_chars > 500) WHERE trim(text) <> ''""")
def unpivoted_sections(spark, d):
    docs = table(spark, d, "documents")
    wide = docs.select("doc_id", *[F.when(F.col("lang") == s, F.col("text")).alias(s) for s in LANGUAGES], F.when(F.col("n_chars") > 500, F.col("source")).alias("source"))
    return extract.unpivot_sections(wide, "doc_id", [*LANGUAGES, "source"]).select("doc_id", "section", F.md5("text").alias("h"))


@query(f"""WITH {_SCORED}, k AS (SELECT r.*, lang FROM r JOIN documents USING (doc_id) WHERE score >= 5)
  SELECT doc_id, {", ".join(f"CAST(coalesce({s}.n, 0) AS INT) AS {s}_count" for s in LANGUAGES)}, coalesce({", ".join(f"{s}.first" for s in LANGUAGES)}) AS first FROM documents
  {" ".join(f"LEFT JOIN (SELECT doc_id, count(*) AS n, md5(arg_min(sentence, rank)) AS first FROM k WHERE lang = '{s}' GROUP BY doc_id) {s} USING (doc_id)" for s in LANGUAGES)}""")
def section_extractions(spark, d):
    """The basic extractor over a section for each language, its records back as list columns."""
    docs = table(spark, d, "documents").select("doc_id", *[F.when(F.col("lang") == s, F.col("text")).alias(s) for s in LANGUAGES])
    long = extract.basic_candidates(extract.unpivot_sections(docs, "doc_id", list(LANGUAGES)), ["doc_id", "section"], "text", driver.PACK)
    wide = extract.pivot_extractions(docs, long, "doc_id", list(LANGUAGES), "basic", 5.0)
    first = F.coalesce(*[F.get(F.col(f"{s}_basic_extraction"), F.lit(0))["text"] for s in LANGUAGES])
    return wide.select("doc_id", *[F.col(f"{s}_basic_extraction_count").alias(f"{s}_count") for s in LANGUAGES], F.md5(first).alias("first"))


@query(f"""WITH {_SCORED}, v AS (SELECT l.doc_id, quality AS label, m.model, CAST(b.best >= m.least AS INT) AS pred FROM labels l
    LEFT JOIN (SELECT doc_id, max(score) AS best FROM r GROUP BY doc_id) b USING (doc_id), (VALUES ('any', 0.1), ('numbers', 10.0), ('license', 20.0)) m(model, least)),
  w AS (SELECT doc_id, label, model, coalesce(pred, 0) AS pred FROM v)
  SELECT model, {driver._RATES} FROM (SELECT model, {driver._COUNTS} FROM w GROUP BY model)
  UNION ALL SELECT 'majority', {driver._RATES} FROM (SELECT {driver._COUNTS} FROM (SELECT doc_id, max(label) AS label, CAST(avg(pred) >= 0.667 AS INT) AS pred FROM w GROUP BY doc_id))""")
def extractor_votes(spark, d):
    """What the basic extractor finds at three strengths, each a model, against the labels, and their majority."""
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    found = extract.basic_candidates(table(spark, d, "documents").select("doc_id", "text"), ["doc_id"], "text", driver.PACK)
    # each vote reads it, and the majority reads the votes
    best = sinks.stored(found.groupBy("doc_id").agg(F.max("score").alias("best")))
    votes = None
    for model, least in (("any", 0.1), ("numbers", 10.0), ("license", 20.0)):
        one = evaluate.predictions_from(labels, best.where(F.col("best") >= least), "doc_id").withColumn("model", F.lit(model))
        votes = one if votes is None else votes.unionByName(one)
    every = votes.select("doc_id", "label", "model", "pred").unionByName(evaluate.majority(votes, "doc_id").select("doc_id", "label", F.lit("majority").alias("model"), "pred"))
    return evaluate.rounded(evaluate.confusion(every, ["model"]))


# -- text functions --


_EXAMPLE = _sub(_sub(_sub(_strip("text"), r"^\[''|''\]$", ""), rf'^"|"{_S}*$', ""), f"{_S}+", " ")
_EXAMPLE = chained(_EXAMPLE, (("isallowed", "is allowed"), ("isset", "is set"), ("isallowedin", "is allowed in"), ("allowedforjin", "allowed for jin"), (r"allowed\.the", "allowed. The")))
_CLAUSE_TEXT = driver._CLEANED_CLAUSE.replace("(x", "(text")
_HEADER_TEXT = f"regexp_replace(upper({_strip(_sub('''replace(translate(text, chr(34) || chr(39), ''), 'ß', 'ss')''', _S + '+', ' '))}), '[.:]$', '')"


@query(f"""SELECT doc_id, md5({driver._GRAM_TEXT("text")}) AS grams, md5({_CLAUSE_TEXT}) AS clause, md5({_EXAMPLE}) AS example,
  md5({chained("text", ((p, "") for p in R.DOCUMENT_IDS))}) AS ids, md5({_HEADER_TEXT}) AS header, regexp_matches(lower(text), 'license|of the') AS keyword FROM documents""")
def text_forms(spark, d):
    t = F.col("text")
    forms = {"grams": T.clean_for_grams, "clause": lambda c: T.clean_sentence(c, driver.SPARSE_PACK.rewrites), "example": T.clean_example, "ids": T.remove_ids, "header": T.normalize_header}
    # bound one by one: together their generated method is too long for the JVM to compile
    return driver.texts(spark, d).select("doc_id", *[T.let(t, lambda x: F.md5(f(x))).alias(n) for n, f in forms.items()], T.has_keyword(t, ("license", "of the")).alias("keyword"))


_LISTED = [_bare(_sub(_sub(f"lower({c})", r"\[|\]|''''|``", " "), rf"({_W})[.]({_W})", r"\1. \2")) for c in ("lang", "source")]


@query(f"SELECT doc_id, {_LISTED[0]} || '|' || {_LISTED[1]} AS quoted, lang || '|' || source AS literal, lang AS first, CAST(n_chars AS DOUBLE) AS score FROM documents")
def list_texts(spark, d):
    """Lists that other tools keep as text."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    text = F.concat(F.lit("['"), "lang", F.lit("', '"), "source", F.lit("']"))
    records = F.concat(F.lit("[{'text': '"), "lang", F.lit("', 'score': "), F.col("n_chars").cast("string"), F.lit(", 'match_type': 'exact'}]"))
    first = F.get(T.parse_extractions(records), F.lit(0))
    return docs.select("doc_id", F.array_join(T.parse_list_text(text), "|").alias("quoted"), F.array_join(files.literal_list(text), "|").alias("literal"), first["text"].alias("first"), first["score"].alias("score"))


@query(r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS x FROM documents),
  h AS (SELECT regexp_replace(regexp_extract(x, '^\s*([A-Z][A-Z\s\d\.\-\:]{2,})\s*$', 1), '^\s+|\s+$', '', 'g') AS header FROM l WHERE regexp_matches(x, '^\s*([A-Z][A-Z\s\d\.\-\:]{2,})\s*$')),
  c AS (SELECT header, count(*) AS count FROM h WHERE NOT regexp_matches(header, '^[A-Z]{1,2}\d+\s*-\s*\d+|^X+$|^X+\s+X+|^\d+$|^[A-Z]\.$|^[IVX]+\.$|^[A-Z]{1,2}\d+$')
    AND (length(header) - length(replace(header, 'X', ''))) * 2 <= length(header) AND len(regexp_split_to_array(header, '\s+')) <= 6 GROUP BY header)
  SELECT header, count FROM c WHERE NOT regexp_matches(header, 'NIL|CORAM|AMENDED|PRIVATE|HUIS|CLOS') AND length(regexp_replace(header, '\P{L}', '', 'g')) * 2 >= length(header) AND length(header) <= 30""")
def true_headers(spark, d):
    return sections.true_headers(sections.header_counts(sections.header_lines(table(spark, d, "documents"), "doc_id", "text")))


# -- archives, examples, whole runs --


def _archived(spark: SparkSession, d: str) -> str:
    """An archive of text files named like cases, one file that isn't, and a CSV of the regions."""
    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()
    regions = "r_regionkey;r_name\n" + "".join(f"{r.r_regionkey};{r.r_name}\n" for r in table(spark, d, "region").orderBy("r_regionkey").collect())
    files_ = {f"cases/2021canlii{r.n_nationkey}.txt": r.n_name for r in rows} | {"cases/readme.md": "no case", "regions.csv": regions}
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, text in files_.items():
            info = tarfile.TarInfo(name)
            info.size = len(text.encode())
            tar.addfile(info, io.BytesIO(text.encode()))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/all.tar.gz")
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    stream.write(bytearray(out.getvalue()))
    stream.close()
    return at.toString()


@query("""SELECT '2021' AS year, CAST(n_nationkey AS VARCHAR) AS "decisionID", n_name AS full_text FROM nation""")
def archived_cases(spark, d):
    return files.read_case_archive(spark, _archived(spark, d))


@query("SELECT r_regionkey, r_name FROM region")
def archived_csv(spark, d):
    return files.read_archived_csv(spark, _archived(spark, d), ";", "r_regionkey int, r_name string")


@query("""SELECT '.txt' AS extension, count(*) AS members, CAST(sum(strlen(n_name)) AS BIGINT) AS bytes FROM nation UNION ALL SELECT '.md', 1, 7
  UNION ALL SELECT '.csv', 1, CAST(19 + (SELECT sum(strlen(CAST(r_regionkey AS VARCHAR)) + strlen(r_name) + 2) FROM region) AS BIGINT)""")
def archive_contents(spark, d):
    return files.archive_profile(spark, _archived(spark, d)).drop("archive")


@query("""SELECT doc_id, '{"lang": "' || lang || '", "source": "' || source || '"}' AS record FROM documents""")
def ascii_records(spark, d):
    record = files.ascii_json(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    return table(spark, d, "documents").select("doc_id", record.alias("record"))


@query("SELECT DISTINCT t AS text FROM (SELECT p_name AS t FROM part UNION ALL SELECT p_type FROM part) WHERE length(trim(t)) > 10")
def example_bank(spark, d):
    """Training examples of a list column that is kept as text."""
    raw = table(spark, d, "part").select(F.to_json(F.array("p_name", "p_type")).alias("raw"))
    return extract.basic_examples(raw, "raw")


_FOUND = "SELECT doc_id, score FROM r WHERE (best >= 10 AND score >= greatest(5, best * 0.7) AND rank <= 5) OR (best < 10 AND rank <= 3)"


@query(f"""WITH {_SCORED}, f AS (SELECT 'basic' AS extractor, doc_id FROM ({_FOUND}) UNION ALL SELECT 'strong', doc_id FROM ({_FOUND}) WHERE score >= 10),
  k AS (SELECT extractor, doc_id, n_chars % 4 AS expected, (SELECT count(*) FROM f WHERE f.doc_id = documents.doc_id AND f.extractor = x.extractor) AS found FROM documents, (VALUES ('basic'), ('strong')) x(extractor)),
  m AS (SELECT *, found / greatest(1, expected) AS ratio FROM k)
  SELECT 'driver' AS experiment, extractor, round(avg(found), 9) AS avg_extracted_count, round(avg(expected), 9) AS avg_expected_count, round(avg(ratio), 9) AS avg_count_ratio,
  count(*) FILTER (ratio >= 1) AS cases_meeting_expected, count(*) AS total_cases, round(count(*) FILTER (ratio >= 1) / count(*), 9) AS pct_meeting_expected FROM m GROUP BY extractor""")
def experiment_summary(spark, d):
    """Two extractors over one validation set."""
    docs = table(spark, d, "documents").select("doc_id", "text", (F.col("n_chars") % 4).alias("determination_count"))

    @cache
    def basic(v: DataFrame) -> DataFrame:
        """Written once for both extractors."""
        return sinks.stored(extract.Basic(driver.PACK).extract(v, ["doc_id"], "text").select("doc_id", "text", "score"))

    run = experiments.Experiment("driver", {"basic": basic, "strong": lambda v: basic(v).where("score >= 10")})
    out = experiments.run_experiment(run, docs, docs.select("doc_id", "text"), "doc_id", "text")
    return out.withColumns({c: F.round(c, 9) for c in ("avg_extracted_count", "avg_expected_count", "avg_count_ratio", "pct_meeting_expected")})


@query(f"""WITH {_SCORED}, x AS ({driver.oracle_text("sparse_extraction")}), y AS ({_FOUND})
  SELECT doc_id, CAST((SELECT count(*) FROM x WHERE x.doc_id = documents.doc_id) AS INT) AS sparse, CAST((SELECT count(*) FROM y WHERE y.doc_id = documents.doc_id AND score >= 5) AS INT) AS basic FROM documents""")
def staged_run(spark, d):
    """The staged pipeline: sparse, then basic, each stage a table that the next one reads."""
    config = {"key": "doc_id", "text": "text", "sections": ["text"], "active_stages": ["sparse", "basic"]}
    # dealt by key once: what the sparse stage finds is ranked, grouped and joined to its text where that lies
    docs = table(spark, d, "documents").select("doc_id", "text").repartition("doc_id")
    out = staged.run(spark, docs, scratch(spark), config, staged.Context(sparse=driver.SPARSE_PACK, basic=driver.PACK))
    return spark.read.parquet(out["final"]).select("doc_id", F.col("sparse_explicit_extraction_count").alias("sparse"), F.col("text_basic_extraction_count").alias("basic"))
