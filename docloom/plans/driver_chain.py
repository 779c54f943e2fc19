"""Driver queries over whole chains: preprocessing over bucketed tables, text for models, several extractors at once, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.functions import text as T
from docloom.operators import extract, neural, templates
from docloom.plans import driver, driver_io, preprocess, staged
from docloom.plans.driver import _S, _SCORED, _sentences, _strip, _sub, _words, query, table, texts
from docloom.sources import files
from docloom.sources.sinks import stored


@query("""WITH own AS (SELECT n_chars AS id FROM documents GROUP BY n_chars HAVING count(*) > 1),
  bad AS (SELECT id FROM own UNION SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING count(*) > 1),
  t AS (SELECT n_chars AS id, text FROM documents WHERE n_chars NOT IN (SELECT id FROM own)),
  d AS (SELECT l_partkey AS id, count(*) AS n, string_agg(l_returnflag, ',' ORDER BY l_orderkey * 8 + l_linenumber, l_returnflag) AS l FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM bad) GROUP BY l_partkey),
  e AS (SELECT * FROM customer WHERE c_custkey NOT IN (SELECT id FROM bad)),
  s AS (SELECT o_custkey AS id, string_agg(o_orderpriority, ' ' ORDER BY o_orderkey) AS s FROM orders WHERE o_custkey NOT IN (SELECT id FROM bad) GROUP BY o_custkey)
  SELECT p_partkey AS id, p_brand AS decision_outcome, md5(t.text) AS full_text, coalesce(d.n, 0) AS determination_count, coalesce(d.l, '') AS determinations,
    e.c_mktsegment AS decision_outcome_estimated, e.c_acctbal AS balance, md5(s.s) AS sentence_text
  FROM part LEFT JOIN t ON t.id = p_partkey LEFT JOIN d ON d.id = p_partkey LEFT JOIN e ON e.c_custkey = p_partkey LEFT JOIN s ON s.id = p_partkey
  WHERE p_partkey NOT IN (SELECT id FROM bad)""")
def preprocessing_chain(spark, d):
    """Safe keys, numbered sentences, the purge of duplicated ids, and the enrichment of a split over bucketed tables."""
    key = preprocess.KEY
    given = {
        "case_texts": table(spark, d, "documents").select(F.col("n_chars").alias(key), F.col("text").alias("full_text")),
        "all_sentences": table(spark, d, "orders").select(F.col("o_custkey").alias(key), F.col("o_orderpriority").alias("Text"), F.col("o_orderkey").alias("ord")),
        "determination": table(spark, d, "lineitem").select(F.col("l_partkey").alias(key), F.col("l_returnflag").alias("extracted_sentences_determination"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")),
        "train": table(spark, d, "part").select(F.col("p_partkey").alias(key), F.col("p_brand").alias("decision_outcome")),
        "test": table(spark, d, "customer").select(F.col("c_nationkey").alias(key), F.col("c_mktsegment").alias("decision_outcome")),
        "entities": table(spark, d, "customer").select(F.col("c_custkey").alias(key), F.col("c_mktsegment").alias("decision_outcome"), F.col("c_acctbal").alias("balance")),
    }
    good, _, _ = preprocess.clean(preprocess.prepared(given))
    out = preprocess.enriched(preprocess.bucketed({n: good[n] for n in good if n != "test"}), "train")
    listed = F.array_join("extracted_sentences_determination", ",")
    return out.select(F.col(key).alias("id"), "decision_outcome", F.md5("full_text").alias("full_text"), "determination_count", listed.alias("determinations"), "decision_outcome_estimated", "balance", F.md5("sentence_text").alias("sentence_text"))


#: A public vocabulary; any tokenizer file that the executors can read serves.
TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


@query()
def neural_extraction(spark, d):
    """Sentences that a network finds likely to stand in poor documents: trained on sentences of the labelled ones, applied to all."""
    docs = files.spread(table(spark, d, "documents").select("doc_id", "text"))
    labels = table(spark, d, "labels").where("quality IS NOT NULL").groupBy("doc_id").agg((1 - F.max("quality")).alias("label"))
    examples = extract.explode_sentences(docs.join(labels, "doc_id"), ["label"], "text", T.model_sentences).select(F.col("sentence").alias("text"), "label")
    weights, _ = neural.train(examples, TOKENIZER)
    out = neural.Network(weights, TOKENIZER, 0.42).extract(docs, ["doc_id"], "text")
    return out.select("doc_id", "text", F.round("score", 6).alias("score"), "rank")


TEMPLATE_PACK = templates.TemplateRules(
    groups=(r"licensed|released|rights", r"the .* and "),
    slots=(
        templates.Slot(r"(?s)^(.*?under the )(.*?)( license.*)$", r"[a-z0-9\s.\-]+"),
        templates.Slot(r"(?s)^(.*?version )([0-9.]+)(.*)$", r"[0-9.]+", 1),
        templates.Slot(r"(?s)^(.*?the )(.*?)( and .*)$", r"[^,]+"),
    ),
)
_FILLED = [f"CASE WHEN len({_words(f"regexp_extract(t, '{s.pattern}', 2)")}) BETWEEN 1 AND {s.words} THEN regexp_replace(t, '{s.pattern}', '\\1' || chr({k + 1}) || '\\3') END" for k, s in enumerate(TEMPLATE_PACK.slots)]


@query(f"""WITH s AS (SELECT lower(unnest({_sentences("text")})) AS t FROM documents),
  g AS (SELECT t FROM s WHERE {" OR ".join(f"regexp_matches(t, '{g}')" for g in TEMPLATE_PACK.groups)}),
  m AS (SELECT unnest(list_distinct(list_filter([t, {", ".join(_FILLED)}], lambda x: x IS NOT NULL))) AS template FROM g)
  SELECT md5(template) AS template, count(*) AS n FROM m GROUP BY template""")
def mined_templates(spark, d):
    """Templates of all sentences of the documents that belong to a group."""
    rows = texts(spark, d).select(F.explode(T.sentences(F.col("text"))).alias("text"))
    return templates.mined(rows, "text", TEMPLATE_PACK).select(F.md5("template").alias("template"), "n")



# RE2 has no look-ahead: what ends a field is put back; the prose has no list literals, court files or reviews to cut.
_CUTS = (
    (r"\\u[0-9a-fA-F]{4}", " "), (r"(?i)\[REDACTED.*?\]", " "), (r"\[\d+\]", " "), (r"\b\d{5,}\b", " "),
    (rf"(?i)({R.MONTHS}){_S}+\d{{1,2}},{_S}+\d{{4}}", " "), (r"\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b", " "),
    (rf"(?i)(File|Client|UCI|Application){_S}+(No|Number|ID)\.*{_S}*:.*?({_S}{_S}|$)", r" \3"), (rf"(?i)Date{_S}*:{_S}*.*?({_S}{_S}|$)", r" \1"), (rf"(?i)\(signed\).*?({_S}{_S}|$)", r" \1"),
    (rf"{_S}+", " "), (rf"[^\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}\t-\r \x{{85}}\x{{A0}}.,!?;:''-]", " "), (rf"{_S}+", " "),
)


def _for_model(t: str) -> str:
    t = f"replace(replace({_strip(t)}, chr(92) || 'n', ' '), chr(10), ' ')"
    for pattern, to in _CUTS:
        t = _sub(t, pattern, to)
    return _strip(t)


@query(rf"""WITH c AS (SELECT doc_id, {_for_model("text")} AS t FROM documents),
  s AS (SELECT doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x) <> '') AS s FROM c),
  k AS (SELECT doc_id, list_filter(s, lambda x: len({_words("x")}) >= 3 AND NOT regexp_matches(x, '(?i){R.ADMIN_SENTENCE}') AND 3 * len(regexp_extract_all(x, '\p{{Nd}}+')) <= len({_words("x")})) AS s FROM s)
  SELECT c.doc_id, md5(t) AS cleaned, len(s) AS n, md5(array_to_string(s, chr(10))) AS sentences FROM c JOIN k USING (doc_id)""")
def model_sentences(spark, d):
    """Documents cleaned and cut for a neural scorer."""
    cleaned = texts(spark, d).select("doc_id", T.clean_for_model(F.col("text")).alias("t"))
    out = cleaned.select("doc_id", "t", T.cut_for_model(F.coalesce("t", F.lit(""))).alias("s"))
    return out.select("doc_id", F.md5("t").alias("cleaned"), F.size("s").cast("bigint").alias("n"), F.md5(F.array_join("s", "\n")).alias("sentences"))


@query(f"""WITH {_SCORED}, k AS (SELECT doc_id, lang, n_chars, count(*) FILTER (score >= 5) AS n FROM documents LEFT JOIN r USING (doc_id) GROUP BY doc_id, lang, n_chars)
  SELECT lang || '_text' AS section, 'basic' AS model, count(*) AS n, round(avg(n), 6) AS mean, median(n) AS median, round(stddev_samp(n), 6) AS std, round(avg(n / nullif(n_chars // 1000, 0)), 6) AS mean_ratio
  FROM k GROUP BY lang""")
def section_model_report(spark, d):
    """The hits of the basic extractor in each section that a document has, against what is expected of it."""
    names = [f"{s}_text" for s in driver_io.LANGUAGES]
    docs = table(spark, d, "documents")
    wide = docs.select("doc_id", F.floor(F.col("n_chars") / 1000).alias("determination_count"), *[F.when(F.col("lang") == s, F.col("text")).alias(f"{s}_text") for s in driver_io.LANGUAGES], *[F.when(F.col("lang") == s, F.lit(True)).alias(f"has_{s}") for s in driver_io.LANGUAGES])
    long = extract.basic_candidates(extract.unpivot_sections(wide, "doc_id", names), ["doc_id", "section"], "text", driver.PACK)
    found = extract.pivot_extractions(wide, long, "doc_id", names, "basic", 5.0)
    # the report needs neither texts nor records; without the texts the join moves none
    found = stored(found.drop(*names, *[f"{s}_basic_extraction" for s in names]))
    out = reduce(DataFrame.unionByName, [staged.section_report(found, s, "basic", "doc_id") for s in names])
    return out.select("section", "model", "n", F.round("mean", 6).alias("mean"), "median", F.round("std", 6).alias("std"), F.round("mean_ratio", 6).alias("mean_ratio"))


@query(f"""SELECT 'sparse' AS model, doc_id, md5(text) AS h, position, CAST(rank AS BIGINT) AS rank FROM ({driver.oracle_text("sparse_extraction")})
  UNION ALL SELECT 'basic', doc_id, h, position, rank FROM ({driver.oracle_text("basic_selection")})""")
def several_extractors(spark, d):
    """Two extractors over all documents in one long table."""
    out = extract.apply_all(texts(spark, d), {"sparse": extract.Sparse(driver.SPARSE_PACK), "basic": extract.Basic(driver.PACK)}, ["doc_id"], "text")
    return out.select("model", "doc_id", F.md5("text").alias("h"), F.round("position", 9).alias("position"), F.col("rank").cast("bigint").alias("rank"))


_ITEM = _sub(_strip(_sub(_strip("x"), r"^\[+|\]+$", "")), "^[''\"]|[''\"]$", "")


@query(rf"""WITH s AS (SELECT doc_id, list_transform({_sentences("translate(text, chr(34) || chr(39) || chr(92), '')")}, lambda x: {_strip(_sub("x", _S + "+", " "))}) AS s FROM documents),
  c AS (SELECT doc_id, list_filter(list_transform(flatten(list_transform(s, lambda x: regexp_split_to_array(x, '{driver._CLAUSE}'))), lambda x: {_ITEM}), lambda x: x <> '' AND NOT {driver._lacks_letter("x")}) AS c FROM s WHERE len(s) > 0)
  SELECT doc_id, CAST(len(c) AS BIGINT) AS n, md5(array_to_string(c, chr(10))) AS clauses FROM c""")
def listed_clauses(spark, d):
    """Documents as list literals of their sentences, and the clauses of their items."""
    items = F.transform(T.sentences(F.translate("text", "\"'\\", "")), T.squeeze)
    docs = texts(spark, d).select("doc_id", items.alias("s")).where(F.size("s") > 0)
    literal = F.concat(F.lit("['"), F.array_join("s", "', '"), F.lit("']"))
    out = docs.select("doc_id", T.listed_clauses(literal).alias("c"))
    return out.select("doc_id", F.size("c").cast("bigint").alias("n"), F.md5(F.array_join("c", "\n")).alias("clauses"))
