"""Text functions, Column to Column.  All are native expressions; null text gives null unless a function says else."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import rules as R

U = R.UNICODE


def sub(c: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(c, F.lit(flags + U + pattern), F.lit(replacement))


def fold(c: Column, pairs) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def let(value: Column, body) -> Column:
    """Binds `value` once for `body`: a lambda that names an expression would compute it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def where(value: Column, test, body) -> Column:
    """`body` of the value where the test holds, else the value: spares a dear pattern by a cheap test."""
    return let(value, lambda t: F.when(test(t), body(t)).otherwise(t))


#: What `\s` matches among Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def has_text(c: Column) -> Column:
    """Whether `strip` leaves anything; the text's end isn't searched."""
    return F.ltrim(c, F.lit(WHITE)) != ""


def squeeze(c: Column) -> Column:
    """White space runs to one blank, ends trimmed.  A single blank is left as it stands, as it is most of them."""
    return F.btrim(sub(c, r"\s(?:(?<! )\s*|\s+)", " "))


def words(c: Column) -> Column:
    """White-space separated words; blank text has none."""
    t = strip(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, U + r"\s+"))


def word_count(c: Column) -> Column:
    """How many words `words` gives, without cutting the text."""
    return F.regexp_count(c, F.lit(U + r"\S+"))


def _bare(c: Column) -> Column:
    """Non-words to blanks, but for apostrophes inside words."""
    kept = sub(c, r"(\w)'(\w)", "$1§$2")
    return squeeze(F.replace(sub(kept, r"[^\w\s§]", " "), F.lit("§"), F.lit("'")))


def clean(c: Column) -> Column:
    """Lower case, brackets and doubled quotes out, joined sentences parted, punctuation out.  Null gives ''."""
    t = sub(F.lower(c), r"\[|\]|''|``", " ")
    return F.coalesce(_bare(sub(t, r"(\w)\.(\w)", "$1. $2")), F.lit(""))


def clean_for_grams(c: Column, rewrites=R.NGRAM_REWRITES) -> Column:
    """Lower case, known run-together words parted, punctuation out.  Null gives ''."""
    return F.coalesce(_bare(fold(F.lower(c), rewrites)), F.lit(""))


def clean_sentence(c: Column, rewrites=R.SPARSE_REWRITES) -> Column:
    """For whole-sentence comparison: outer brackets and quotes out, lower case, rewrites in order, end punctuation out."""
    edge = lambda *marks: lambda t: reduce(or_, [f(t, F.lit(m)) for m in marks for f in (F.startswith, F.endswith)])
    t = where(strip(c), edge("[", "]"), lambda t: strip(F.rtrim(F.ltrim(t, F.lit("[")), F.lit("]"))))
    t = fold(F.lower(where(t, edge("'", '"'), lambda t: sub(t, r"^['\"]|['\"]\z", ""))), rewrites)
    t = where(t, lambda t: F.contains(t, F.lit(".")), lambda t: sub(t, r"(\w)\.(\w)", "$1 $2"))
    return where(squeeze(t), edge(*".,;:"), lambda t: F.btrim(t, F.lit(".,;:")))


def clean_example(c: Column) -> Column:
    """A training sentence without its list or quote wrapper; null where nothing is left."""
    t = sub(strip(c), r"^\['|'\]\z", "")
    t = sub(sub(t, r'^"|"\s*\z', ""), r"\s+", " ")
    for old, new in R.EXAMPLE_REWRITES:
        t = sub(t, old, new, "(?iu)")
    return F.nullif(t, F.lit(""))


def _unwrapped(c: Column) -> Column:
    """The only string of a list literal, or the joined string values of a JSON object."""
    t = strip(c)
    single = F.regexp_extract(t, r"(?s)^\['((?:[^'\\]|\\.)*)'\]\z", 1)
    loose = F.btrim(t, F.lit("[]'"))
    pairs = F.from_json(t, "map<string,string>")
    joined = F.array_join(F.filter(F.map_values(pairs), lambda v: v.isNotNull()), " ")
    is_list = F.startswith(t, F.lit("['")) & F.endswith(t, F.lit("']"))
    is_map = F.startswith(t, F.lit('{"')) & F.endswith(t, F.lit('"}'))
    return F.when(is_list, F.when(single != "", single).when(F.contains(t, F.lit("', '")), t).otherwise(loose)).when(is_map, F.coalesce(joined, t)).otherwise(t)


def clean_for_model(c: Column) -> Column:
    """Text for a neural scorer: wrappers, escapes, redactions, ids, citations, dates, file lines, signatures and odd
    characters out."""
    t = F.replace(F.replace(_unwrapped(c), F.lit("\\n"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    for pattern, flags in R.MODEL_NOISE:
        t = sub(t, pattern, " ", flags)
    return squeeze(sub(sub(t, r"\s+", " "), r"[^\w\s.,!?;:'-]", " "))


def normalize_punctuation(c: Column) -> Column:
    """No blank before a period, one after it, exactly one at the end; nothing else left stays empty."""
    t = F.rtrim(sub(sub(c, r"\s+\.", "."), r"\.\s*", ". "), F.lit(". "))
    return F.when(t == "", t).otherwise(F.concat(t, F.lit(".")))


def remove_ids(c: Column, patterns: tuple[str, ...] = R.DOCUMENT_IDS) -> Column:
    for p in patterns:
        c = sub(c, p, "", "(?iu)")
    return c


def clean_for_training(c: Column, patterns: tuple[str, ...] = R.DOCUMENT_IDS) -> Column:
    """A labelled sentence without ids, dates, numbers, brackets and edge junk; '' where too little is left or null."""
    t = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\n"), F.lit(" ")), F.lit("\\r"), F.lit(" "))
    t = sub(remove_ids(t, patterns), r"\s+", " ")
    for pattern in R.TRAINING_NOISE:
        t = sub(t, pattern, "")
    t = sub(sub(t, r"^[-\\/\s]+", ""), r"[-\\/\s]+\z", "")
    t = strip(normalize_punctuation(t))
    return F.when((F.char_length(t) < 5) | t.rlike(U + r"^[\d\s\-\\/\.]+\z"), F.lit("")).otherwise(t)


def normalize_whitespace(c: Column) -> Column:
    """One blank for several, paragraphs parted by one empty line, lines and text trimmed."""
    t = F.regexp_replace(F.regexp_replace(c, " +", " "), "\n+", "\n\n")
    return strip(F.array_join(F.transform(F.split(t, "\n"), strip), "\n"))


def clean_redactions(c: Column) -> Column:
    return F.replace(F.regexp_replace(c, "X{3,}", "[REDACTED]"), F.lit("[REDACTION]"), F.lit("[REDACTED]"))


def remove_page_pointers(c: Column, patterns: tuple[str, ...] = R.PAGE_POINTERS) -> Column:
    for p in patterns:
        c = sub(c, p, "")
    return c


def is_foreign_line(line: Column, stop_words: tuple[str, ...] = R.FRENCH_WORDS, patterns: tuple[str, ...] = R.FRENCH_PATTERNS, share: float = R.FRENCH_SHARE) -> Column:
    """More than `share` of a line's words are stop words, or a pattern is found; blank lines are not."""
    w = words(F.lower(line))
    stops = F.array(*[F.lit(x) for x in stop_words])
    many = F.size(F.filter(w, lambda x: F.array_contains(stops, x))) > F.lit(share) * F.size(w)
    return (F.size(w) > 0) & (many | line.rlike(R.one_of(patterns) if patterns else r"\z."))


def remove_foreign_lines(c: Column, stop_words: tuple[str, ...] = R.FRENCH_WORDS, patterns: tuple[str, ...] = R.FRENCH_PATTERNS) -> Column:
    return F.array_join(F.filter(F.split(c, "\n"), lambda x: ~is_foreign_line(x, stop_words, patterns)), "\n")


def extract_metadata(c: Column, patterns: tuple[str, ...] = R.METADATA) -> Column:
    """struct(text, metadata): the first match of the first pattern found is cut out."""
    found, at = F.lit(None).cast("string"), F.lit(0)
    for p in reversed(patterns):
        hit = F.regexp_substr(c, F.lit(U + p))
        found, at = F.coalesce(hit, found), F.when(hit.isNotNull(), F.instr(c, hit)).otherwise(at)
    rest = F.when(found.isNull(), c).otherwise(F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.char_length(found), F.char_length(c))))
    return F.struct(strip(rest).alias("text"), strip(found).alias("metadata"))


def _pieces(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def sentences(c: Column) -> Column:
    """Line ends become blanks; cut after . ! ? and white space; trimmed, empty ones out.  Null has none."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "\n+", " ")
    return _pieces(F.split(t, U + r"(?<=[.!?])\s+"))


_CLAUSES = U + r"\s*[,;]\s*|\s+and\s+"

#: Where clauses end.  Blanks go with the mark before them, so an `and` that begins a sentence is none that cuts; one that ends a
#: sentence is left by what must not follow.  A run of blanks is tried at its beginning only, and letters are passed over at once.
_CUTS = U + r"(?:(?=[.!?,;])|(?=\s)(?<!\s))(?:\s*[.!?,;]+\s*|(?<=\])\s+(?=\[)|\s+and\s++(?![.!?]))"


def clauses(c: Column) -> Column:
    """Cut at . ! ? and between `]` and `[`, at commas, semicolons and ` and `, all at once.  Numbers and blanks out."""
    parts = F.split(strip(F.coalesce(c, F.lit(""))), _CUTS)
    return F.filter(parts, lambda s: (s != "") & ~s.rlike(U + r"^\d+\z"))


def listed_clauses(c: Column) -> Column:
    """The clauses of a list literal of strings; null where the text isn't such a list."""
    items = F.from_json(F.translate(c, "'", '"'), "array<string>")
    wrapped = F.startswith(c, F.lit("[")) & F.endswith(c, F.lit("]"))
    bare = lambda s: strip(sub(strip(sub(strip(s), r"^\[+|\]+\z", "")), r"^['\"]|['\"]\z", ""))
    parts = F.transform(F.flatten(F.transform(F.filter(items, lambda s: s.isNotNull()), lambda s: F.split(s, _CLAUSES))), bare)
    return F.when(wrapped & items.isNotNull(), F.filter(parts, lambda s: (s != "") & ~s.rlike(U + r"^\d+\z")))


def model_sentences(c: Column, admin: str = R.ADMIN_SENTENCE) -> Column:
    """Sentences for a neural scorer: cut before capitals, short, administrative and numeric ones out."""
    return cut_for_model(clean_for_model(F.coalesce(c, F.lit(""))), admin)


def cut_for_model(c: Column, admin: str = R.ADMIN_SENTENCE) -> Column:
    """The sentences of a text that `clean_for_model` gave."""
    parts = _pieces(F.split(c, U + r"(?<=[.!?])\s+(?=[A-Z])"))
    few = lambda s: let(word_count(s), lambda n: (n >= 3) & (F.regexp_count(s, F.lit(U + r"\d+")) * 3 <= n))
    return F.filter(parts, lambda s: few(s) & ~s.rlike("(?iu)" + U + admin))


def parse_list_text(c: Column) -> Column:
    """Sentences of a list column kept as text: JSON after quotes are doubled, else single-quoted parts, else the
    whole; all cleaned, empty ones out."""
    t = sub(strip(F.coalesce(c, F.lit(""))), r"^\[|\]\z", "")
    nested = F.startswith(t, F.lit("[")) | F.startswith(t, F.lit("{"))
    items = F.when(nested, F.from_json(F.translate(t, "'", '"'), "array<string>", {"allowSingleQuotes": "false"}))
    parts = F.regexp_extract_all(t, F.lit("'([^']+)'"), F.lit(1))
    chosen = F.when(t == "", F.array().cast("array<string>")).when(items.isNotNull(), items).when(F.size(parts) > 0, parts).otherwise(F.array(t))
    return F.filter(F.transform(chosen, clean), lambda s: s != "")


def parse_example_text(c: Column) -> Column:
    """Examples kept as text: a JSON list of strings or of objects with `text`, an object with `text`, else the whole."""
    t = F.coalesce(c, F.lit(""))
    quoted = F.translate(t, "'", '"')
    strict = {"allowSingleQuotes": "false"}
    objects = F.from_json(quoted, "array<struct<text:string>>", strict)
    named = F.filter(F.transform(objects, lambda o: o["text"]), lambda s: s.isNotNull())
    strings = F.filter(F.from_json(quoted, "array<string>", strict), lambda s: s.isNotNull())
    single = F.get_json_object(quoted, "$.text")
    is_list = F.startswith(t, F.lit("[")) & strings.isNotNull()
    out = F.when(is_list & (F.size(named) > 0), named).when(is_list, strings).when(F.startswith(t, F.lit("{")) & single.isNotNull(), F.array(single)).otherwise(F.array(t))
    return F.when(strip(t) == "", F.array().cast("array<string>")).otherwise(out)


EXTRACTION = "array<struct<text:string,score:double,match_type:string>>"


def parse_extractions(c: Column) -> Column:
    """A list of extraction records kept as text; an apostrophe inside any text empties the field.  Null: empty."""
    none = F.array().cast(EXTRACTION)
    return F.coalesce(F.from_json(F.translate(c, "'", '"'), EXTRACTION, {"allowSingleQuotes": "false"}), none)


def normalize_header(c: Column) -> Column:
    """Quotes out, blanks squeezed, upper case, one trailing period or colon out."""
    return F.regexp_replace(F.upper(squeeze(F.translate(c, "\"'", ""))), r"[.:]\z", "")


def header_candidates(c: Column, min_words: int = 1, max_words: int = 6) -> Column:
    """Lines in capitals that may be section headers: no codes, numerals or redactions, of a bounded word count."""
    found = F.transform(F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(R.HEADER_LINE)), lambda x: strip(F.regexp_extract(x, R.HEADER_LINE, 1)))
    bad = "|".join(f"(?:{p})" for p in R.HEADER_EXCLUDES)
    few = lambda h: F.regexp_count(h, F.lit("X")) * 2 <= F.char_length(h)
    size = lambda h: F.size(words(h)).between(min_words, max_words)
    return F.filter(found, lambda h: ~h.rlike(bad) & few(h) & size(h))


def has_keyword(c: Column, keywords: tuple[str, ...] = R.TRAINING_KEYWORDS) -> Column:
    """Any keyword is a substring of the lower-cased text."""
    return F.lower(c).rlike(R.quoted(keywords))


def padded(c: Column) -> Column:
    """The text between blanks."""
    return F.concat(F.lit(" "), c, F.lit(" "))


def between(c: Column, keyword: str) -> Column:
    """The keyword stands between blanks in a text that `padded` gave."""
    return F.contains(c, F.lit(f" {keyword} "))


def bounded(c: Column, keyword: str) -> Column:
    """The keyword stands in the text between blanks."""
    return between(padded(c), keyword)


def ngrams(c: Column, low: int = 2, high: int = 4) -> Column:
    """The word n-grams of a cleaned text, sizes low to high; none below `low` words."""
    of = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return let(words(c), lambda w: F.flatten(F.array(*[of(w, n) for n in range(low, high + 1)])))


def span_class(text: Column, spans: Column, label: str = "DETERMINATION", word: str = "determination") -> Column:
    """1 if a span has the label, else 2 if the word is in the text, else 0."""
    hit = F.coalesce(F.exists(spans, lambda s: F.coalesce(s["label"] == label, F.lit(False))), F.lit(False))
    return F.when(hit, 1).when(F.contains(F.lower(text), F.lit(word)), 2).otherwise(0)


def augment(c: Column, key: Column, seed: int = 42, drop: float = 0.15, swap: float = 0.10) -> Column:
    """Drops one word with probability `drop`, then swaps two with probability `swap`; three words or fewer stay.

    All chances come from hashes of (seed, key), so a row always changes alike."""
    number = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(k)), key.cast("string"))), 1, 8), 16, 10).cast("bigint")
    chance = lambda k: number(k) / F.lit(float(1 << 32))
    pick = lambda k, n: (F.pmod(number(k), n.cast("long")) + 1).cast("int")

    def swapped(less: Column) -> Column:
        a = pick(4, F.size(less))
        b = F.pmod(a - 1 + pick(5, F.size(less) - 1), F.size(less)) + 1
        moved = F.transform(less, lambda x, i: F.when(i + 1 == a, F.element_at(less, b)).when(i + 1 == b, F.element_at(less, a)).otherwise(x))
        return F.when(chance(3) < swap, moved).otherwise(less)

    dropped = lambda w: F.when(chance(1) < drop, F.filter(w, lambda x, i: i + 1 != pick(2, F.size(w)))).otherwise(w)
    return let(words(c), lambda w: F.when(F.size(w) <= 3, c).otherwise(F.array_join(let(dropped(w), swapped), " ")))
