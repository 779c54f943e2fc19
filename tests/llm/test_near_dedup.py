import random
import re

import corpus_pipeline
from docloom.llm import near_dedup
from docloom.llm.common import materialize
from tests.llm.data import documents, empty
from tests.llm.test_simhash import WORD


def brute_shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def brute_components(texts, ids, limit=0.8):
    sets, parent = [brute_shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            if brute_similarity(sets[i], sets[j]) >= limit:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(sets))]


def planted():
    """Texts of 300 words with copies in which 1 to 12 far words change: similarities from 0.97 down to below 0.7."""
    rng, rows = random.Random(3), []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(300)]
        rows.append((1000 + 20 * g, " ".join(words)))
        for k in range(1, 13):
            copy = list(words)
            for p in rng.sample(range(10, 290, 10), k):
                copy[p] = f"new{g}x{k}x{p}"
            rows.append((1000 + 20 * g + k, " ".join(copy)))
    return rows


def test_stage_drops_planted_copies_of_0_8_to_0_95(spark):
    rows = planted()
    text = dict(rows)
    near = [(a, b) for a in text for b in text if a < b and a // 20 == b // 20 and 0.8 <= brute_similarity(brute_shingles(text[a]), brute_shingles(text[b])) <= 0.95]
    assert len(near) > 50
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.near(spark, docs, "")
    want = brute_components([t for _, t in rows], [i for i, _ in rows])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns


def test_components_equal_brute_force(spark):
    docs = documents(spark, [(5000 + i, t, "en", "a", 1, None, None) for i, t in planted()]).where("doc_id is not null")
    rows = docs.collect()
    want = brute_components([r.text for r in rows], [r.doc_id for r in rows])
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()} == {r.doc_id: c for r, c in zip(rows, want, strict=True)}


def test_null_id_and_empty_table(spark):
    assert near_dedup.near_duplicates(documents(spark)).count() == documents(spark).count()
    assert sum(r.doc_id is None for r in near_dedup.keep_first(documents(spark)).collect()) == 1
    assert near_dedup.keep_first(empty(spark)).count() == 0


def test_stage_equals_brute_force_on_its_own_input(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, sf)
    docs = materialize(docs, "test-near")
    rows = docs.collect()
    want = brute_components([r.text for r in rows], [r.doc_id for r in rows])
    assert sorted(r.doc_id for r in corpus_pipeline.near(spark, docs, sf).collect()) == sorted(set(want))
