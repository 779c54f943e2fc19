import random
import re

from pyspark.sql import functions as F

from docloom.operators import templates
from docloom.operators.templates import LEGAL_TEMPLATES, alternation, compiled, learned_patterns, mined


def plain(s):
    """The templates of one example, by cutting at the words around a slot."""
    s, out = s.lower(), {s.lower()}
    if not (("appeal" in s and any(w in s for w in ("allowed", "dismissed", "refused"))) or ("appellant" in s and "status" in s) or any(w in s for w in ("humanitarian", "removal order", "refugee", "protection"))):
        return set()
    for k, lead in enumerate(("appeal of ", "appeal for ")):
        head, found, tail = s.partition(lead)
        name, link, rest = tail.partition(" is ")
        if found and link and 0 < len(name.split()) <= 3:
            out.add(f"{head}{lead}{chr(1 + k)} is {rest}")
    m = re.match(r"(.*?file )\s*([a-z0-9\-]+)(\s.*|)\Z", s, re.S)
    if m:
        out.add(f"{m[1]}{chr(3)}{m[3]}")
    return out


EXAMPLES = [
    "The appeal of John Doe is allowed", "The appeal of Jane Roe is allowed", "the appeal for A B C is dismissed", "The appeal of one two three four is refused",
    "File AB-1 refugee claim", "File CD-2 refugee claim", "file  x9", "refugee file", "refugee file no_good here", "nothing of note", "", None,
    "The appellant lost status", "status of appellant", "protection", "The appeal of X is allowed. The appeal for Y is dismissed (file 12).",
]


def test_mined_templates_equal_a_plain_scan(spark):
    df = spark.createDataFrame([(e,) for e in EXAMPLES], "text string")
    want = {}
    for e in EXAMPLES:
        for t in plain(e or ""):
            want[t] = want.get(t, 0) + 1
    got = {r.template: r.n for r in mined(df).collect()}
    assert got == want and got["the appeal of \1 is allowed"] == 2 and got["file \3 refugee claim"] == 2


def test_alternations_match_what_their_templates_match():
    rng = random.Random(13)
    shapes = (r"[a-z]+", r"[0-9]+")
    for _ in range(60):
        given = sorted({"".join(rng.choice("ab.\1\2 (") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))})
        pattern = alternation(given, shapes)
        each = ["".join(shapes[ord(c) - 1] if c in "\1\2" else re.escape(c) for c in t) for t in given]
        for _ in range(40):
            text = "".join(rng.choice("ab.7 (") for _ in range(rng.randint(0, 8)))
            assert bool(re.search(pattern, text)) == any(re.search(p, text) for p in each)
            assert bool(re.fullmatch(pattern, text)) == any(re.fullmatch(p, text) for p in each)


def test_beginnings_stand_once(spark):
    df = spark.createDataFrame([(f"the appeal is dismissed for reason {i:03d}",) for i in range(120)], "template string").coalesce(1)
    rows = compiled(df).collect()
    assert sum(r.n for r in rows) == 120 and max(r.n for r in rows) == 50
    assert all(r.pattern.count("dismissed") == 1 for r in rows)
    out = df.where(F.col("template").rlike("|".join(f"^{r.pattern}$" for r in rows)))
    assert out.count() == 120


def test_patterns_are_bounded(spark, monkeypatch):
    df = spark.createDataFrame([(e,) for e in EXAMPLES], "text string")
    found = learned_patterns(df)
    assert all(any(re.search(p, t.replace("\1", "x y").replace("\2", "z").replace("\3", "q-1")) for p in found) for e in EXAMPLES for t in plain(e or ""))
    monkeypatch.setattr(templates, "MOST_CHARS", 10)
    try:
        learned_patterns(df)
    except ValueError as e:
        assert "at most 10" in str(e)
    else:
        raise AssertionError
    assert learned_patterns(df.where("text = 'none'")) == () and LEGAL_TEMPLATES.slots[2].words == 1
