"""Tiny tables over few and many partitions, and texts of millions of like characters."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidegrid.llm import ngram_join, packing, token_lengths, tokens, voronoi

LONG = [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x " + " " * 1_000_000 + "y<|endoftext|> z"]


@pytest.mark.parametrize(
    ("partitions", "texts"),
    [
        (1, []), (3, [None]), (1, ["one two three four five six"]), (200, ["a b c d e f", "g h i j k l"]),
        (3, [None, "", "a b", "a b", "c"]),
    ],
)
def test_the_join_of_few_documents(spark, partitions, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(partitions)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_components(docs).collect()}
    assert found == {k: texts.index(t) if t else k for k, t in enumerate(texts)}


def test_the_join_of_unlike_documents_over_many_partitions(spark):
    texts = [" ".join(f"w{k}x{n}" for n in range(8)) for k in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(200)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        found = ngram_join.ngram_jaccard_components(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in found) == [(k, k, 4) for k in range(20)]


@pytest.mark.parametrize("text", LONG, ids=["spaces", "newlines", "letters", "special"])
def test_ids_of_long_runs_are_those_of_the_files_own_library(text):
    path = tokens.default_path()
    wanted = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert tokens.ids_of(text, path).tolist() == wanted


def test_long_runs_are_counted_and_packed(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(LONG[:3])] + [(9, "short")], "doc_id long, text string")
    path = tokens.default_path()
    sizes = {k: len(tokens.ids_of(t, path)) + 1 for k, t in enumerate(LONG[:3])}
    packed = packing.pack_documents(docs).toPandas()
    assert packed.groupby("doc_id")["length"].sum().loc[[0, 1, 2]].to_dict() == sizes
    counted = {r["length"]: r["documents"] for r in token_lengths.length_histogram(docs).collect()}
    assert all(counted[n - 1] == 1 for n in sizes.values()) and sum(counted.values()) == 4


def test_search_among_vectors_of_several_lengths_and_of_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, 1.0]), (2, [1.0, 1.0, 1.0]), (50, [2.0, 2.0, 0.5]), (100, []), (3, []), (4, None), (150, [1.0])]
    found = voronoi.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1, 65536 * 5), (50, 1, 2, 65536 * 4 + 32768), (100, 1, 3, 0)]


def test_scores_that_do_not_fit_are_an_error(spark):
    vectors = spark.createDataFrame([(0, [1e300, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="may not fit"):
        voronoi.exact_top_k(vectors)
    large = spark.createDataFrame([(0, [2.0**22, 0.0]), (1, [2.0**22, -1.0])], "vec_id long, embedding array<double>")
    assert [r["score"] for r in voronoi.exact_top_k(large).collect()] == [1 << 60]


def test_products_are_exact_beyond_doubles():
    a = np.array([[2**30, 1]]), np.array([[2**30, 1]])
    assert voronoi._products(*a).tolist() == [[2**60 + 1]]
