"""The digest columns of the registered queries against their contracts, by brute force over whole small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from tokenizers import Tokenizer

from docloom.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def given(spark, sf, tmp_path_factory):
    """(folder, rows) of a `documents` table with nulls, empty texts, copies and ties."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(70).collect()]
    texts = [t for _, t, *_ in rows if t]
    passage = "one passage of more than fifty bytes that stands in several documents at once"
    rows += [(901, None, "en", None, 0), (902, "", "en", "z", 0), (903, " \n ", "en", "z", 3), (904, texts[0], "en", "a", 1), (905, f"x {passage} y", "en", "a", 1), (906, f"{passage} {passage}", "fr", "é", 1), (907, texts[1] + " end", "de", None, 1)]
    folder = tmp_path_factory.mktemp("contracts")
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_media(spark, given):
    got = by_id(queries.op1_media(spark, given[0]))
    forms = defaultdict(set)
    for i, text, *_ in given[1]:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got.pop(i)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > 0 and len(r.media_sha256) == 64
        forms[text or ""].add((r.media_bytes, r.media_sha256, r.feature))
    assert not got and all(len(f) == 1 for f in forms.values())


def test_mixing(spark, given):
    got = by_id(queries.op5_mixing(spark, given[0]))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in given[1]}
    of = {i: s for i, _, _, s, _ in given[1]}
    sources = Counter()
    for i, n in size.items():
        sources[of[i]] += n
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sources[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sources[s]
            left -= target[s]
        open_ -= over
    taken = Counter()
    for i, r in got.items():
        assert (r.size, r.source_size) == (size[i], sources[of[i]]) and r.target == pytest.approx(target[of[i]])
        assert 0 <= r.taken <= 3 * r.size
        taken[of[i]] += r.taken
    assert set(got) == set(size)
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in order)


def test_packing(spark, given):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, inside = defaultdict(list), defaultdict(list)
    for r in queries.op6_packing(spark, given[0]).collect():
        pieces[r.doc_id].append(r)
        inside[r.sequence_id].append((r.offset, r.length))
    for i, text, *_ in given[1]:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces
    for parts in inside.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= 2048


def test_substrings(spark, given):
    got = by_id(queries.op8_substring_dedup(spark, given[0]))
    seen: set[bytes] = set()
    for i, text, *_ in sorted(given[1]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        mine = [raw[k : k + 50] for k in range(len(raw) - 49)]
        for k, s in enumerate(mine):
            if s in seen:
                gone[k : k + 50] = True
        seen.update(mine)
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        r = got.pop(i)
        spans = int((gone[1:] < gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert not got


def test_simhash(spark, given):
    got = by_id(queries.op9_simhash(spark, given[0]))
    prints = {}
    for i, text, *_ in given[1]:
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(root[b] for b in prints if (prints[a] ^ prints[b]).bit_count() <= 3)
            if low < root[a]:
                root[a], changed = low, True
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{p:016x}", root[i]) for i, p in prints.items()}
