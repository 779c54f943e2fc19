import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import extract, templates


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")


def rows(df):
    return [(r.id, r.text, r.score, r.match_type) for r in df.orderBy("id", "rank").collect()]


@pytest.mark.parametrize("text", ["The appeal is allowed", "appeal is allowed", "The appeal is dismissed", "appeal is dismissed", "[appeal is allowed]", "['appeal is allowed']", "appeal is allowed.the"])
def test_sparse_hits(spark, text):
    assert docs(spark, text).select(extract.sparse_hit(F.col("text"))).first()[0]


def test_sparse_rules(spark):
    hit = lambda t: docs(spark, t).select(extract.sparse_hit(F.col("text"))).first()[0]
    assert hit("appeal of Mr X is allowed") and hit("NEGATIVE") and hit("The RAD confirms the decision")
    assert not hit("the appeal is long") and not hit("negative result")
    # rewriting plurals makes a plural phrase dead, but not a pattern
    assert not hit("reject the claimants explanation")


def test_sparse_keeps_order_and_repeats(spark):
    got = extract.sparse(docs(spark, "First, appeal is dismissed. Nothing. appeal is dismissed and appeal is allowed", "['the appeal is allowed', 'no']", None, ""), ["id"], "text")
    assert [r[:2] for r in rows(got)] == [(0, "appeal is dismissed"), (0, "appeal is dismissed"), (0, "appeal is allowed"), (1, "the appeal is allowed")]


def test_basic_scores(spark):
    score = lambda t, rules=R.LEGAL_BASIC: docs(spark, t).select(extract.basic_score(F.col("text"), rules)).first()[0]
    assert score("The appeal is refused today") == 20
    assert score("The appeals were rejected") == 10
    assert score("sufficient humanitarian and compassionate reasons exist") == 15
    assert score("taxi find") == 5
    assert score("it was thus allowed by them") == 2.5
    assert score("thus, it was over") == 0
    assert score("a " * 31) == -0.5
    learned = R.BasicRules(classes=(), exact=(), keywords=(), outcomes=(), learned=templates.learned_patterns(spark.createDataFrame([("The appeal of John Doe is allowed",), ("File AB-1 refugee claim",), ("nothing of note",)], "text string")))
    assert 1 <= len(learned.learned) <= 4
    assert score("the appeal of someone else is allowed", learned) == 5.5
    assert score("file zz-9 refugee claim", learned) == 5
    assert score("nothing of note", learned) == 0


def test_basic_places_and_selection(spark):
    text = "appeal is allowed. I find so. appeal is allowed. x y z w v. appeal is allowed"
    text = text.replace("allowed. ", "allowed.  ")
    got = extract.basic_candidates(docs(spark, "appeal is allowed\n\n. I find it. Plain words of no use here."), ["id"], "text")
    assert rows(got)[0][2:] == (20.0, "pattern")
    # an exact sentence stands at its last place, others at their first
    examples = spark.createDataFrame([("Exactly this sentence.",)], "text string")
    t = "Exactly this sentence. I find a. I find a. Exactly this sentence. End of it all now."
    cand = {r.text: r for r in extract.basic_candidates(docs(spark, t), ["id"], "text", examples=examples).collect()}
    assert cand["Exactly this sentence."].match_type == "exact" and cand["Exactly this sentence."].position == 0.75
    assert cand["I find a."].position == 0.25 and cand["I find a."].length == 9
    many = ". ".join(f"appeal is allowed {i}" for i in range(7)) + ". I find it"
    assert len(rows(extract.basic(docs(spark, many), ["id"], "text"))) == 5
    weak = ". ".join(f"I find it {i}" for i in range(5))
    assert [r[1] for r in rows(extract.basic(docs(spark, weak), ["id"], "text"))] == ["I find it 0.", "I find it 1.", "I find it 2."]
    assert rows(extract.basic(docs(spark, None, "", " "), ["id"], "text")) == []
    # 10 points keep what reaches 7
    mixed = "the appeals was rejected. I find it. the panel are satisfied"
    assert [r[2] for r in rows(extract.basic(docs(spark, mixed), ["id"], "text"))] == [10.0]


RULES = R.NgramRules(direct=(r"\bclaim\s+is\s+over",), phrases=("appeal is allowed",), markers=("marker",), long_openers=("DECISION",), short_openers=("CONCLUSION",), threshold=0.65, stop_gram=3)


def bank(spark, *texts):
    return extract.gram_bank(spark.createDataFrame([(t,) for t in texts], "text string"), RULES)


def brute_match(s, texts):
    """The rules for one cleaned sentence, said again over plain lists."""
    words = s.split()
    if len(words) < 3:
        return None
    if s in texts:
        return 1.0, s
    subs = [(min(len(t), len(s)) / max(len(t), len(s)), t) for t in texts if 0.6 * len(s) <= len(t) <= 1.4 * len(s) and (t in s or s in t)]
    good = sorted((-r, t) for r, t in subs if r >= RULES.threshold)
    if good:
        return -good[0][0], good[0][1]
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(2, 5) for i in range(len(w) - n + 1)]
    index = {}
    for t in texts:
        for g in set(grams(t.split())):
            index.setdefault(g, set()).add(t)
    mine = grams(words)
    counts = {}
    for g in mine:
        if len(index.get(g, ())) <= RULES.stop_gram:
            for t in index.get(g, ()):
                counts[t] = counts.get(t, 0) + 1
    found = sorted((-c / len(mine), t) for t, c in counts.items() if c / len(mine) >= RULES.threshold)
    return (-found[0][0], found[0][1]) if found else None


def test_gram_match_equals_brute_force(spark):
    import random

    rng = random.Random(4)
    vocabulary = ["aa", "bb", "cc", "dd", "e"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = sorted({say(rng.randrange(2, 9)) for _ in range(60)})
    given = sorted({say(rng.randrange(1, 10)) for _ in range(150)} | {t + " aa" for t in texts[:20]} | {t[1:] for t in texts[:20]} | set(texts[:5]))
    b = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.cleaned: (round(r.match, 9), r.matched_text) for r in extract.gram_match(spark.createDataFrame([(s,) for s in given], "cleaned string"), b, RULES).collect()}
    want = {s: m for s in given if (m := brute_match(s, texts))}
    assert got == {s: (round(m[0], 9), m[1]) for s, m in want.items()}
    assert len(want) > 20 and len(want) < len(given)


def test_ngram_cascade(spark):
    b = bank(spark, "the quick brown fox jumps over", "an indexed sentence")
    text = "The claim is over now. He said the appeal is allowed. An indexed sentence! Marker: the quick brown fox jumps over it. The quick brown fox jumps high."
    got = {r.text: r for r in extract.ngram_candidates(docs(spark, text), ["id"], "text", b, RULES).collect()}
    kinds = {"The claim is over now.": "direct_pattern", "He said the appeal is allowed.": "phrase_match", "An indexed sentence!": "exact", "Marker: the quick brown fox jumps over it.": "ngram"}
    assert {t: r.match_type for t, r in got.items()} == kinds
    assert got["He said the appeal is allowed."].matched_text == "appeal is allowed"
    assert got["An indexed sentence!"].score == 20.0
    # without a marker only what follows an opening header is matched
    lead = "DECISION here. " + "Filler words go. " * 6 + "The quick brown fox jumps over it. " + "The quick brown fox jumps over us."
    kinds = {r.text: r.match_type for r in extract.ngram_candidates(docs(spark, lead), ["id"], "text", b, RULES).collect()}
    assert kinds == {"The quick brown fox jumps over it.": "ngram"}


def test_ngram_selection(spark):
    rows_ = [(0, f"d{i}", 18.0, "phrase_match", i + 1) for i in range(3)] + [(0, "N high", 19.0, "ngram", 4), (0, "n HIGH", 17.5, "ngram", 5), (0, "n low", 16.0, "ngram", 6), (1, "n mid", 16.0, "ngram", 1), (1, "n none", 14.0, "ngram", 2)]
    rows_ += [(2, f"x{i}", 20.0, "exact", i + 1) for i in range(9)]
    df = spark.createDataFrame(rows_, "id bigint, text string, score double, match_type string, rank int")
    got = [(r.id, r.text) for r in extract.select_grams(df, ["id"]).orderBy("id", "rank").collect()]
    assert got[:5] == [(0, "d0"), (0, "d1"), (0, "d2"), (0, "N high"), (1, "n mid")]
    assert len(got) == 11


def test_neural_threshold_and_single_scoring(spark):
    def scorer(batches):
        for s in batches:
            yield s.str.len() / 100.0

    text = "A short one here. " + "This is a much longer sentence that goes on. " * 2
    got = extract.neural(docs(spark, text), ["id"], "text", scorer, threshold=0.3).collect()
    assert len(got) == 2 and all(r.score == len(r.text) / 100.0 for r in got)


def test_sections_pivot(spark):
    df = spark.createDataFrame([(1, "appeal is allowed", None, "c"), (2, None, " ", "d")], "id bigint, a_text string, b_text string, cleaned_text string")
    long = extract.unpivot_sections(df, "id", ["a_text", "b_text"])
    assert [(r.id, r.section) for r in long.collect()] == [(1, "a_text")]
    out = extract.pivot_extractions(df, extract.basic(long, ["id", "section"], "text"), "id", ["a_text", "b_text"], "basic", 5.0).orderBy("id").collect()
    assert [r.a_text_basic_extraction_count for r in out] == [1, 0] and out[1].a_text_basic_extraction == []
    assert [r[0] for r in df.orderBy("id").select(extract.scored_text(df, ["a_text", "b_text"])).collect()] == ["appeal is allowed", "d"]


def test_a_large_bank_is_joined_by_shuffles_alike(spark, monkeypatch):
    bank = spark.createDataFrame([(f"the appeal number {i} is allowed by this court today",) for i in range(30)], "text string")
    rows = spark.createDataFrame([(f"the appeal number {i} is allowed by this court",) for i in range(40)] + [("something else stands here",)], "cleaned string")
    small = sorted(map(tuple, extract.gram_match(rows, bank).collect()))
    assert extract.is_small(bank)
    monkeypatch.setattr(extract, "SMALL_BANK", 1)
    assert not extract.is_small(bank) and sorted(map(tuple, extract.gram_match(rows, bank).collect())) == small and len(small) >= 30
