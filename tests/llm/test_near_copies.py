"""Words, the n-gram join and components, against plain versions."""

import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import components, ngram_join
from tidegrid.llm.words import SPACE, Splitter, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) >= 5:
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    return frozenset([tuple(words)] if words else [])


def plain_components(rows):
    """doc_id -> (set size, component) for rows with ids, every pair compared."""
    sets = [plain_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if rows[i][0] == rows[j][0] and sets[i] == sets[j] or both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé \n\t.x", max_size=60)), max_size=12), st.integers(1, 40))
def test_words_and_shingles_are_those_of_the_pattern(texts, chunk):
    splitter = Splitter(SPACE, chunk)
    hashes, sizes, counts = {}, [], []
    for _, words in splitter.batches(pa.array(texts, pa.string())):
        for k, found in enumerate(shingle_sets(words, 5)):
            sizes.append(len(found))
            own = words.hashes[words.bounds[k] : words.bounds[k + 1]]
            counts.append([int(h) for h in own])
    for text, own in zip(texts, counts, strict=True):
        words = WORD.findall((text or "").translate(LOWER))
        assert len(words) == len(own)
        for word, value in zip(words, own, strict=True):
            assert hashes.setdefault(word, value) == value
    assert len(set(hashes.values())) == len(hashes)
    assert sizes == [len(plain_set(text)) for text in texts]


def corpus(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    passage = " ".join(rng.choices(vocabulary, k=40))
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([6, 30, 90]))
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((doc, " ".join(copy)))
            doc += 3
    for _ in range(10):
        rows.append((doc, " ".join(rng.choices(vocabulary, k=60)) + " " + passage))
        doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \n "), (doc + 3, "One two"), (doc + 4, "one  TWO"), (doc + 5, "one")]
    rng.shuffle(rows)
    return rows


def test_components_equal_all_pairs(spark):
    rows = corpus()
    table = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, n int, node string, id int")
    found = ngram_join.ngram_jaccard_components(table.repartition(5)).collect()
    assert sorted(map(tuple, found)) == plain_components(rows)


def test_large_group_of_near_copies_in_blocks(spark, monkeypatch):
    """Blocks of few rows give what one block gives."""
    monkeypatch.setattr(ngram_join, "PER_HUB", 3)
    monkeypatch.setattr(ngram_join, "ROWS_PER_BLOCK", 2)
    monkeypatch.setattr(ngram_join, "BROADCAST_SETS", 0)
    rng = random.Random(1)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for doc in range(60):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            copy[rng.randrange(60)] = f"c{doc}-{rng.randrange(99)}"
        rows.append((doc, " ".join(copy)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_components(table).collect())) == plain_components(rows)


def test_rows_without_id_and_repeated_rows(spark):
    text = "a b c d e f g"
    rows = [(None, text), (4, text), (4, text), (2, text), (2, "z y x w v u"), (9, "z y x w v u")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.ngram_jaccard_components(table).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in found if r["doc_id"]) == [
        (False, 2, 2, 2),
        (False, 2, 3, 2),
        (False, 4, 3, 2),
        (False, 4, 3, 2),
        (False, 9, 2, 2),
    ]
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [None]
    kept = ngram_join.without_near_copies(table).collect()
    assert sorted((r["doc_id"] or -1) for r in kept) == [-1, 2]


def test_empty_table(spark):
    table = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert ngram_join.ngram_jaccard_components(table).count() == 0
    assert ngram_join.without_near_copies(table).columns == ["doc_id", "text", "lang"]


def test_components_of_chains_stars_and_noise(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(100, 140)] + [(500, k) for k in range(501, 540)] + [(7, 7), (None, 3), (600, 601), (601, 600)]
    edges = [edges[k] for k in rng.permutation(len(edges))]
    found = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    wanted = {(k, 100) for k in range(101, 141)} | {(k, 500) for k in range(501, 540)} | {(601, 600)}
    assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)


@pytest.mark.parametrize("passes", [2, 5])
def test_passes_over_the_columns_give_the_same(spark, passes):
    rows = corpus(8)
    table = spark.createDataFrame(rows, "id long, text string").repartition(5)
    join = ngram_join.NgramJaccardJoin(table, passes=passes)
    assert sorted(map(tuple, join.classes().collect())) == plain_components(rows)


def test_what_the_result_does_not_read_is_deleted(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.iterdir())
    table = spark.createDataFrame([(doc, text, "de") for doc, text in corpus()], "doc_id long, text string, lang string")
    kept = ngram_join.one_row_of_each_component(table)
    labels = {path.name.split("-")[1] for path in set(folder.iterdir()) - before if path.name.startswith("tidegrid")}
    assert labels == {"numbered", "dropped", "links", "edges"}
    assert kept.count() == len({(row[2], row[0] if not row[1] else None) for row in plain_components(corpus())})


@pytest.mark.parametrize("size,percent,passes", [(0, 75, 1), (5, 0, 1), (5, 101, 1), (5, 75, 0)])
def test_parameters_are_checked(spark, size, percent, passes):
    with pytest.raises(ValueError):
        ngram_join.NgramJaccardJoin(spark.createDataFrame([], "id long, text string"), size, percent, passes)
