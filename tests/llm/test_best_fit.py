import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from docloom.llm import best_fit, queries
from tests.llm.data import documents, empty


def piece_by_piece(histogram, size):
    """What is left in each sequence when every piece goes to the tightest one that fits."""
    left = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [(room, i) for i, room in enumerate(left) if room >= length]
            if fits:
                left[min(fits)[1]] -= length
            else:
                left.append(size - length)
    return sorted(left)


def test_plan_equals_packing_piece_by_piece():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([1, 5, 16, 31, 64])
        histogram = {rng.randint(1, size): rng.randint(1, 20) for _ in range(rng.randint(1, 12))}
        steps, made = best_fit.plan(histogram, size)
        inside = defaultdict(list)
        for length, s in steps.items():
            for k in range(histogram[length]):
                at = np.searchsorted(s[:, 0], k, side="right") - 1
                nth = k - s[at, 0]
                inside[int(s[at, 1] + nth // s[at, 2])].append((int(s[at, 3] + nth % s[at, 2] * length), length))
        for pieces in inside.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
        assert sorted(size - sum(n for _, n in x) for x in inside.values()) == piece_by_piece(histogram, size)
        assert sorted(inside) == list(range(made))


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(4)
    for most in (10, 10**6, 10**12):
        steps, _ = best_fit.plan({n: rng.randint(1, most) for n in range(1, 2049)})
        assert sum(map(len, steps.values())) < 8 * 2048
    assert best_fit.plan({}) == ({}, 0)


def test_tree_finds_the_tightest():
    rng, tree, held = random.Random(5), best_fit.Capacities(37), defaultdict(int)
    for _ in range(2000):
        c = rng.randint(0, 37)
        step = 1 if not held[c] or rng.random() < 0.4 else -1
        held[c] += step
        tree.add(c, step)
        least = rng.randint(0, 37)
        assert tree.tightest(least) == min((k for k, n in held.items() if n and k >= least), default=None)


ODD = ["x, y.) don't, it's. 'tis' a'. end's!?) a1, b1.5 c_d__ é, né, <|endoftext|>, a<|endoftext|>. s't., x\u0301. n.\u0301 o,\u201d", " ", "a b", "Ünï côde \U0001f600 wörds", "<|endoftext|> x<|startoftext|>y", "it's we'll\x85x\xa0y　z\x1cq\x00r", "ΑΣ ΑΣ́ İx é ́x", "line sep​zero", "7" * 300, "x" * 50_000, "%$#" * 700, "a " * 9000, "\n\t" * 5000, "ﬁ Ǆ ẞ ß", "don't DON'T 's", "<|EndOfText|> A<|endoftext|>B", "A\u0300E\u0301 \u212a"]


def test_words_by_themselves_give_the_tokenizers_ids():
    tok = Tokenizer.from_file(P.path(best_fit.TOKENIZER))
    words = best_fit.Words()
    for t in ODD:
        raw = t.encode()
        assert best_fit.token_ids(raw, words).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t[:20]


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(best_fit, "REMEMBERED", 4)
    words = best_fit.Words()
    for k in range(20):
        assert words[f"w{k}".encode()] == best_fit.Words()[f"w{k}".encode()]
        assert words[b"one"] == best_fit.Words()[b"one"]
        assert len(words) <= 4 and len(words.older) <= 4
    words[b"x" * 1000]
    assert b"x" * 1000 not in words


def check(got, docs):
    tok = Tokenizer.from_file(P.path(best_fit.TOKENIZER))
    inside, rows, histogram = defaultdict(list), defaultdict(list), defaultdict(int)
    for r in got:
        inside[r.sequence_id].append((r.offset, r.length))
        rows[r.doc_id].append(r)
        histogram[r.length] += 1
    for pieces in inside.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= best_fit.LENGTH
    want = defaultdict(list)
    for r in docs:
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), best_fit.LENGTH)):
            cut = ids[start : start + best_fit.LENGTH].tobytes()
            want[r.doc_id].append((piece, start, len(cut) // 4, zlib.crc32(cut)))
    assert {k: sorted(v) for k, v in want.items()} == {k: sorted((r.piece, r.start, r.length, r.ids_crc32) for r in v) for k, v in rows.items()}
    assert len(inside) == best_fit.plan(histogram)[1]
    return len(inside), histogram


@pytest.mark.parametrize("rows", [0, 1 << 20])
def test_pieces_hold_every_id_once(spark, rows):
    docs = documents(spark, [(100 + i, t, "en", "a", 1, None, None) for i, t in enumerate(ODD)]).repartition(3, "doc_id")
    out = best_fit.pack(docs, broadcast_rows=rows)
    made, histogram = check(out.selectExpr("*", "crc32(ids) AS ids_crc32").collect(), docs.collect())
    assert made == len(piece_by_piece(histogram, best_fit.LENGTH))


def test_query_over_whole_documents(spark, sf):
    got = queries.op13_best_fit(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    made, histogram = check(got, docs)
    assert made == len(piece_by_piece(histogram, best_fit.LENGTH))
    assert made <= -(-sum(n * k for n, k in histogram.items()) // best_fit.LENGTH) + 2


def test_empty_table(spark):
    assert best_fit.pack(empty(spark)).count() == 0
