"""Header lines of a text, found by a plain scan: what the native expressions are held against."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from docloom.functions import rules as R


@lru_cache(maxsize=8)
def _compiled(rules: R.HeaderRules) -> list[tuple]:
    """(category, term, words, forms anywhere in a line, forms of a whole line) in the pack's order."""
    out = []
    for category, terms in rules.categories:
        for term in terms:
            t = re.escape(term.upper())
            anywhere = re.compile(rf"{t}\Z|{t}\s*\[\d+\]|[.!?]\s+(?:THE\s+)?{t}")
            spaced = r"\s+".join(r"\s*".join(map(re.escape, w)) for w in term.split())
            whole = re.compile(rf"\s*{spaced}(?:\s*\Z|\s+.*\Z|\s*\[\d+\])", re.IGNORECASE)
            exact = re.compile(rf"\s*(?:\d+\s+)?(?:THE\s+)?{t}\s*[.:]?\s*(?:\[\d+\])?\s*\Z")
            end = re.compile(rf"(.*?[.!?]\s+)({t})(?:\s*\Z|\s*\[\d+\])", re.IGNORECASE)
            out.append((category, term, term.upper().split(), anywhere, whole, exact, end))
    return out


_NUMBERED = re.compile(r"\s*\d+\s+([A-Z][A-Za-z\s]+)\s*\Z")


def bare_line(line: str, rules: R.HeaderRules = R.LEGAL_HEADERS) -> str:
    """A line without quotes and number, or just the term that stands behind its last sentence."""
    line = re.sub(r"\n+", " ", line.translate({34: None, 39: None}))
    numbered = _NUMBERED.match(line)
    if numbered:
        return numbered[1].strip()
    upper = line.upper()
    if any(g in upper for g in rules.gate):
        for _, term, *_, end in _compiled(rules):
            found = end.match(line) if term in upper else None
            if found:
                return found[2].strip()
    return line.strip()


def header_text(line: str) -> str:
    line = re.sub(r"\s+", " ", line.translate({34: None, 39: None}).strip()).upper()
    return line[:-1] if line[-1:] in (".", ":") else line


def classify(line: str, rules: R.HeaderRules = R.LEGAL_HEADERS) -> tuple[str, str] | None:
    """(category, term) of a line, the first in the pack's order; None if it is no header.

    A strict pack takes whole-line headers only."""
    upper = line.upper()
    if not any(g in upper for g in rules.gate):
        return None
    terms = _compiled(rules)
    if rules.strict:
        return next(((c, t) for c, t, _, _, _, exact, _ in terms if exact.match(upper)), None)
    for category, term, _, anywhere, *_ in terms:
        if term.upper() in upper and anywhere.search(upper):
            return category, term
    normal = header_text(bare_line(line, rules))
    for category, term, parts, _, whole, *_ in terms:
        if any(w in upper for w in parts) and whole.match(normal):
            return category, term
    return None


def _readings(lines: list[str], i: int, rules: R.HeaderRules) -> Iterator[tuple[int, str]]:
    """(lines taken, text): the ways to read a header that begins at line i, the preferred first.

    A line with a word of `rules.ahead` may go on over one or two lines that are short or begin with `[`, unless the text's last
    two (or three) lines would be taken."""
    brief = [x.startswith("[") or len(x) < 20 for x in lines[i + 1 : i + 3]]
    reach = 0
    if any(a in lines[i].upper() for a in rules.ahead):
        reach = sum(all(brief[:k]) and i + k < len(lines) - 1 for k in (1, 2))
    return ((n, "\n".join(lines[i : i + n])) for n in (*range(2, reach + 2), 1))


def find_headers(text: str, rules: R.HeaderRules = R.LEGAL_HEADERS) -> list[dict]:
    """The header lines of a text: of each line that isn't part of a header before it, the first reading that is a header."""
    lines, free, out = [x.strip() for x in text.split("\n")], 0, []
    gated = (i for i, x in enumerate(lines) if x and any(g in x.upper() for g in rules.gate))
    for i in gated:
        found = next(((n, t, hit) for n, t in _readings(lines, i, rules) if (hit := classify(t, rules))), None) if i >= free else None
        if found:
            n, joined, (category, term) = found
            free = i + n
            out.append({"line_number": i, "text": joined, "normalized_text": header_text(joined), "category": category, "term": term})
    return out
