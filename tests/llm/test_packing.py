from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from docloom.llm import packing
from tests.llm.data import documents, empty


def test_pieces_hold_every_id_once(spark):
    docs = documents(spark, [(77, "a <|endoftext|> b", "en", "a", 1, None, None)])
    got = packing.pack(docs, range_tokens=20_000).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, rows = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
        rows[r.doc_id].append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= packing.LENGTH
    assert sum(sum(p.length for p in x) < packing.LENGTH for x in by.values()) <= 8
    for r in docs.collect():
        ids = np.array(tok.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        copies = 2 if r.doc_id == 2 else 1
        pieces = sorted(rows[r.doc_id], key=lambda p: p.start)
        assert sum(p.length for p in pieces) == copies * len(ids)
        for p in pieces:
            assert p.doc_tokens == len(ids)
            assert bytes(p.ids) == ids[p.start : p.start + p.length].tobytes()


def test_fast_tokenizer_agrees(spark, sf):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert packing.token_ids(r.text)[:-1].tolist() == tok.encode(r.text, add_special_tokens=False).ids


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = packing.hilbert_key(grid, bits)
        assert sorted(keys) == list(range(len(grid)))
        path = grid[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_empty_table(spark):
    assert packing.pack(empty(spark)).count() == 0


def test_long_runs_equal_the_defining_tokenizer():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    runs = [" ", "\t", "\n", "\xa0", "　", "\r\n", "a", ".", "7", "é", "ab "]
    for n in (4095, 4096, 100_000, 1_000_000):
        for run in runs if n < 1_000_000 else runs[:4] + ["a"]:
            for t in (run * n, f"x {run * n}y", f"{run * n} <|endof" if n == 4096 else run * n):
                assert packing.token_ids(t)[:-1].tolist() == tok.encode(t, add_special_tokens=False).ids


def test_a_document_of_blanks_is_packed(spark):
    rows = [(500 + i, c * 300_000, "en", "a", 1, None, None) for i, c in enumerate(" \n\t\xa0")]
    got = packing.pack(documents(spark, rows)).where("doc_id >= 500").groupBy("doc_id", "doc_tokens").sum("length").collect()
    assert len(got) == 4 and all(r[1] == r[2] for r in got)


def test_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(packing, "MAX_RANGES", 2)
    got = packing.pack(documents(spark), range_tokens=10).select("sequence_id").distinct().collect()
    assert len({r[0] >> 32 for r in got}) <= 2
