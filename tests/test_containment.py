import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import rules as R
from docloom.operators import enrich, extract
from docloom.operators.containment import Bank, containment, shards, touched_within

RULES = R.NgramRules(direct=(), phrases=(), markers=(), long_openers=(), short_openers=(), threshold=0.6, stop_gram=5)


def some_texts():
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = {say(rng.randint(1, 14)) for _ in range(250)}
    long = say(400)
    return texts | {long, long[5:], long[:-9], long[:300], long[:64], long[:65], "ü\U0001f600 " * 30, "ü\U0001f600 " * 29}


def by_pairs(given, bank, low, high):
    return {(s, t) for s in given for t in bank if s and t and low * len(s) <= len(t) <= high * len(s) and (s in t or t in s)}


@pytest.mark.parametrize("chars", [1 << 22, 200, 1])
def test_containment_equals_all_pairs(spark, chars):
    texts = sorted(some_texts())
    given, bank = texts[::2] + texts[1::5] + ["", None], texts[1::2] + texts[::7] + ["", None]
    rows = spark.createDataFrame([(t,) for t in given], "cleaned string").repartition(3)
    out = containment(rows.distinct(), spark.createDataFrame([(t,) for t in bank], "text string"), chars=chars if chars > 1 else 40).collect()
    got = [(r.cleaned, r.text) for r in out]
    assert set(got) == by_pairs(given, bank, 0.6, 1.4) and len(got) == len(set(got)) > 60
    assert all(r.ratio == min(len(r.cleaned), len(r.text)) / max(len(r.cleaned), len(r.text)) for r in out)


def test_shards_are_bounded(spark):
    bank = spark.createDataFrame([("x" * (1 + i % 9),) for i in range(90)] + [("y" * 5000,), (None,), ("",)], "text string")
    found = shards(bank, 60)
    assert [s for s in found if s[0] == 5000] == [(5000, 5000, p, 84) for p in range(84)]
    assert {(a, b) for a, b, *_ in found if a < 10} <= {(k, m) for k in range(1, 10) for m in range(k, 10)}
    assert shards(bank.where("text = 'none'")) == []


def test_nothing_in_the_bank(spark):
    rows = spark.createDataFrame([("one two three",)], "cleaned string")
    assert containment(rows, spark.createDataFrame([], "text string")).count() == 0


def test_only_rows_of_hits_are_made(spark):
    """No piece of a text is a row: the plan has neither a generator nor an exchange."""
    rows = spark.createDataFrame([("one two three",)], "cleaned string")
    out = containment(rows, spark.createDataFrame([("one two three four",)], "text string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Exchange" not in plan and out.count() == 1


def test_texts_too_short_are_not_found():
    bank = Bank(["a", "ab", "abcdefgh"], 0.6, 1.4)
    assert bank.within("abcdefghij") == {2} and bank.within("ab") == {1}
    assert set(bank.around(["ab", "abcdef", "abcde"])) == {(0, 1), (1, 2)}


def grams(t):
    w = t.split()
    return [" ".join(w[i : i + n]) for n in (2, 3, 4) for i in range(len(w) - n + 1)]


def test_shared_grams_equal_all_pairs_and_probe_few(spark):
    rng = random.Random(9)
    usual = [f"w{k}" for k in range(12)]
    texts = sorted({" ".join(rng.choice(usual if rng.random() < 0.7 else [f"r{rng.randint(0, 400)}"]) for _ in range(rng.randint(3, 9))) for _ in range(150)})
    given = set()
    for t in texts[:100]:
        w = t.split()
        w[rng.randrange(len(w))] = "odd"
        given |= {" ".join(w), t, t + " and more", " ".join(rng.choice(usual) for _ in range(8))}
    index = {}
    for t in texts:
        for g in set(grams(t)):
            index.setdefault(g, set()).add(t)
    index = {g: of for g, of in index.items() if len(of) <= RULES.stop_gram}
    want = {}
    for s in given:
        mine = grams(s)
        for t in texts:
            c = sum(t in index.get(g, ()) for g in mine)
            if mine and c / len(mine) >= RULES.threshold:
                want[s, t] = c / len(mine)
    rows, bank = spark.createDataFrame([(s,) for s in given], "cleaned string"), spark.createDataFrame([(t,) for t in texts], "text string")
    got = {(r.cleaned, r.text): r.match for r in extract.shared_grams(rows, bank, RULES).collect()}
    assert got == want and len(want) > 60
    lists = extract.rarest_grams(rows, extract.gram_index(bank, RULES), bank, RULES).collect()
    again = extract.rarest_grams(rows, extract.gram_index(bank, RULES), bank, RULES, small=True).collect()
    assert sorted(map(str, again)) == sorted(map(str, lists))
    assert sum(len(r.probes) for r in lists) < 0.5 * sum(len(r.grams) for r in lists)


@pytest.mark.parametrize("chars", [1 << 22, 60])
def test_unmatched_equals_all_pairs(spark, chars, monkeypatch):
    monkeypatch.setattr(touched_within, "__defaults__", (chars,))
    rng = random.Random(12)
    say = lambda: rng.choice(["", None, "Odd"]) if rng.random() < 0.05 else "".join(rng.choice("aB ") for _ in range(rng.randint(1, 12)))
    key = lambda: rng.choice([1, 1, 1, 2, 3, 4, 5, None])
    given, found = [(i, key(), say()) for i in range(400)], [(key(), say()) for _ in range(40)] + [(3, "x" * 500), (4, "ab" * 40)]
    given += [(900, 3, "x" * 70), (901, 3, "x" * 70 + "y"), (902, 7, "a")]
    low = lambda t: t.strip(" ").lower()
    want = [i for i, k, t in given if k is None or t is None or not any(k == k2 and t2 is not None and (low(t) in low(t2) or low(t2) in low(t)) for k2, t2 in found)]
    a, b = spark.createDataFrame(given, "i int, k int, t string").repartition(3), spark.createDataFrame(found, "k int, t string")
    out = enrich.unmatched(a, b, "k", "t")
    assert sorted(r.i for r in out.collect()) == want and 20 < len(want) < 380
    assert out.columns == ["i", "k", "t"]
    assert enrich.unmatched(a, b.limit(0), "k", "t").count() == len(given)


def test_a_hot_key_of_100_000_texts(spark):
    """All pairs would be 2.5 * 10^9 comparisons."""
    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.concat(F.lit("sentence "), F.md5(F.col("id").cast("string"))).alias("t"), F.col("id"))
    found = rows.where("id < 50000").select("k", F.substring("t", 3, 30).alias("t"))
    begin = time.monotonic()
    assert enrich.unmatched(rows.where("id >= 25000"), found, "k", "t").count() == 50_000
    assert time.monotonic() - begin < 120
