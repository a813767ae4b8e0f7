"""Search, index, archives, lengths and packing: SQL twins, round trips and plain versions."""

import base64
import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import compare
from tidegrid.llm import decontaminate, packing, queries, token_lengths, tokens, voronoi, warc

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_twin(spark, name):
    ours = queries.QUERIES[name](spark, SF).toPandas()
    assert compare.difference(ours, compare.connect(SF).sql(queries.ORACLE_SQL[name]).df()) == ""


def plain_top(rows, k):
    usable = {}
    for vec, x in rows:
        if vec is not None and x is not None and all(v is not None and np.isfinite(v) for v in x):
            usable.setdefault(vec, [int(np.floor(256 * float(v))) for v in x])
    found = []
    for q in usable:
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(usable[q], usable[v], strict=True)), v) for v in usable if v != q)[:k]
            found += [(q, r + 1, v, -s) for r, (s, v) in enumerate(scored)]
    return sorted(found)


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_with_ties_copies_and_unusable_rows(spark, monkeypatch, block):
    monkeypatch.setattr(voronoi, "BLOCK_VECTORS", block)
    monkeypatch.setattr(voronoi, "PACKED_QUERIES", 2)
    rng = np.random.default_rng(0)
    rows = [(k, rng.normal(0, 1, 4).round(2).tolist()) for k in range(260)] + [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(300, 460)]
    rows += [(600, None), (650, [1.0, None, 0.0, 0.0]), (700, [float("nan")] * 4), (750, [float("inf")] * 4), (None, [9.0] * 4)]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, score int").repartition(3)
    found = sorted(tuple(r) for r in voronoi.exact_top_k(frame).collect())
    rounded = [(v, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for v, x in rows]
    assert found == plain_top(rounded, 5)


@pytest.mark.parametrize("block", [4096, 7])
def test_top_k_ranks_every_row_of_a_repeated_id(spark, monkeypatch, tmp_path, block):
    monkeypatch.setattr(voronoi, "BLOCK_VECTORS", block)
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(0, 1, 4).round(2).tolist()) for k in range(120)]
    rows += [(k, [3.0, 3.0, 3.0, 3.0]) for k in [201] * 3 + [202] * 9]  # more rows than k, and fewer
    rows += [(201, [-3.0, 3.0, -3.0, 3.0])] * 2 + [(50, rows[50][1])] * 2 + [(50, [-1.0, -2.0, 0.5, 0.0])] + [(100, rows[100][1])] * 7
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    frame.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        wanted = sorted(db.execute(queries.ORACLE_SQL["op3_voronoi_top_k"]).fetchall())
    assert sorted(map(tuple, voronoi.exact_top_k(frame).collect())) == wanted and len(wanted) == 15


def test_top_k_of_few_and_of_none(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (50, [2.0])], kind)
    assert sorted(map(tuple, voronoi.exact_top_k(few).collect())) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    assert voronoi.exact_top_k(few.limit(0)).count() == 0
    assert voronoi.exact_top_k(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], kind)).count() == 0


ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_contamination_of_edge_cases(spark):
    kind = "doc_id long, text string, word string, pos int"
    docs = [(1, f"x {ITEM.upper()} y"), (2, "alpha beta gamma"), (3, None), (4, ""), (None, ITEM), (1, "clean"), (5, "Tiny-thing tiny thing")]
    frame = spark.createDataFrame([(*d, "w", 1) for d in docs], kind)
    items = [(10, ITEM), (9, ITEM), (9, ITEM), (None, "alpha"), (11, None), (12, "..."), (13, "tiny THING")]
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, row int")
    found = sorted(map(tuple, decontaminate.contamination(frame, bench).collect()), key=str)
    both, tiny, none = (hashlib.sha256(x.encode()).hexdigest() for x in ("10,9", "13", ""))
    assert found == sorted(
        [
            (1, 14, 12, 2, both, True),
            (2, 3, 0, 0, none, False),
            (3, 0, 0, 0, none, False),
            (4, 0, 0, 0, none, False),
            (None, 12, 12, 2, both, True),
            (1, 1, 0, 0, none, False),
            (5, 4, 4, 1, tiny, True),
        ],
        key=str,
    )
    assert {r["n_hit"] for r in decontaminate.contamination(frame, bench.limit(0)).collect()} == {0}
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    kept = decontaminate.clean_documents(frame, bench)
    assert kept.columns == frame.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 2, 3, 4]


def test_shuffled_lookups_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k} {ITEM} tail{k}") for k in range(8)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert {r["n_hit"] for r in decontaminate.contamination(docs, bench).collect()} == {12}


def test_proximity_finds_windows_with_words_moved(spark):
    docs = [(1, "alpha beta new gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "beta alpha gamma delta epsilon zeta eta theta iota kappa"),
            (3, "alpha one two three four five six seven beta gamma delta epsilon zeta eta theta iota kappa")]
    cut = decontaminate.BenchmarkWindows(spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    index = decontaminate.PositionalIndex(spark.createDataFrame(docs, "doc_id long, text string"), cut.vocabulary)
    ids = {r["row"]: r["doc_id"] for r in index.texts.collect()}

    def found(slack):
        return {ids[r["row"]] for r in index.matches(cut.windows, slack).select("row").distinct().collect()}

    assert [found(0), found(2), found(8)] == [{1}, {1, 2}, {1, 2, 3}]


def test_index_runs_no_python(spark):
    docs = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_archives_round_trip(spark, tmp_path):
    texts = [None, "", "same", "same", "é" * 40_000, "unique", "same"]
    rows = [(k, f"http://x/{k} y\r\n" if k % 2 else None, t, "z") for k, t in enumerate(texts)] + [(None, "u", "same", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, key string").repartition(3)
    found = {r["page_id"]: tuple(r)[1:] for r in warc.archived_pages(pages, str(tmp_path / "a")).collect()}
    last = {"": 1, "same": 6, "é" * 40_000: 4, "unique": 5}
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        kept = last[html or ""]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        wanted = (len(payload), digest, "response", None) if page == kept else (len(payload), digest, "revisit", kept)
        assert found[page] == wanted
    assert warc.archived_pages(pages.limit(0), str(tmp_path / "b")).count() == 0
    least = {r["page_id"]: r["record_type"] for r in warc.archived_pages(pages, str(tmp_path / "c"), least_shared=5).collect()}
    assert set(least.values()) == {"response"}


def test_monolith_becomes_members_with_an_index(tmp_path):
    rng = random.Random(0)
    payloads = [bytes(rng.choices(b"ab\r\n", k=n)) for n in (0, 1, 5, 700_000, 3)]
    records = [warc.record(k, None, p, None) for k, p in enumerate(payloads)]
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(b"".join(records)))
    target, sidecar, count = warc.normalise(str(path))
    data = open(target, "rb").read()
    assert count == 5 and gzip.decompress(data) == b"".join(records)
    end = 0
    for line, whole in zip(open(sidecar), records, strict=True):
        offset, length, kind, name = line.rstrip("\n").split("\t")
        assert int(offset) == end and kind == "response"
        end = int(offset) + int(length)
        assert gzip.decompress(data[int(offset) : end]) == whole
    assert end == len(data)
    broken = gzip.compress(records[1].replace(payloads[1] + b"\r\n\r\n", b"!\r\n\r\n"))
    with pytest.raises(ValueError):
        warc.read_member(broken)
    path.write_bytes(gzip.compress(records[3][:-9]))
    with pytest.raises(ValueError):
        warc.normalise(str(path))


TEXTS = ["", None, "Hello world!", "hello  <|endoftext|> x", "naïve Ünïcode 日本 🙂", "a" * 3000, "word " * 4000, "\n\n\t x", "Hello world!"]


@pytest.fixture(scope="module")
def file_library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def test_ids_are_those_of_the_file_s_own_library(spark, file_library):
    import pyarrow.parquet as pq

    texts = [t or "" for t in TEXTS] + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()[:60]
    for text in texts:
        assert tokens.ids_of(text, tokens.default_path()).tolist() == file_library.encode(text, add_special_tokens=False).ids


def test_packing_is_gapless_and_whole(spark, file_library):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "z", "x", 1), (2, TEXTS[2], "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, bucket string, row int")
    found = packing.pack_documents(frame, group_pieces=4).toPandas()
    for doc, text in enumerate(TEXTS):
        ids = np.array([*file_library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        own = found[found.doc_id == doc].drop_duplicates("piece").sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length <= 2048).all() and (own.length.iloc[1:] == 2048).all()
        assert own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert (found.doc_id == 2).sum() == 2 and found.doc_id.isna().sum() == 1
    for _, bin_ in found.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == (bin_.length.cumsum() - bin_.length).tolist() and bin_.length.sum() <= 2048
    assert packing.pack_documents(frame.limit(0)).count() == 0


def test_equal_rows_spread_over_the_groups_and_bins_close(spark, monkeypatch):
    frame = spark.createDataFrame([(1, "same text")] * 4000 + [(None, "same text")] * 100, "doc_id long, text string").repartition(4)
    groups = 8
    found = packing.pack_documents(frame, capacity=10, open_bins=4, group_pieces=4100 // groups + 1).toPandas()
    sizes = (found.sequence_id % groups).value_counts()
    assert len(found) == 4100 and len(sizes) == groups and sizes.max() < 2 * 4100 / groups
    assert found.groupby("sequence_id").length.sum().max() <= 10


def test_few_open_bins_come_near_the_least_number_of_sequences():
    rng = np.random.default_rng(1)
    lengths = np.minimum(np.maximum(rng.lognormal(5.5, 1.2, 16_384), 1), 2048).astype(int)
    bins = packing.OpenBins()
    used = {bins.place(n)[0] for n in lengths.tolist()}
    assert bins.closed > 100 and bins.open <= packing.OPEN_BINS
    assert len(used) <= 1.01 * -(-lengths.sum() // 2048)


@pytest.mark.parametrize("open_bins", [1, 3, 10_000])
def test_best_fit_chooses_the_fullest_bin(open_bins):
    """Against a plain search over a list of open bins."""
    rng = np.random.default_rng(open_bins)
    lengths = rng.integers(1, 101, 400)
    bins, offsets = packing.best_fit(lengths, 100, open_bins)
    free: dict[int, int] = {}
    for k, length in enumerate(lengths.tolist()):
        fitting = [f for f in free.values() if f >= length]
        least = min(fitting, default=100)
        assert offsets[k] == 100 - least and (free.pop(bins[k], 100) == least)
        if least > length:
            free[bins[k]] = least - length
        if len(free) > open_bins:
            full = min(free.values())
            later = set(bins[k + 1 :].tolist())
            closed = [b for b, f in free.items() if f == full]
            free.pop(next((b for b in closed if b not in later), closed[0]))


def test_lengths_and_limits(spark, file_library):
    frame = spark.createDataFrame([(t, 1) for t in TEXTS], "text string, length int")
    histogram = token_lengths.length_histogram(frame)
    sizes = [len(file_library.encode(t or "", add_special_tokens=False).ids) for t in TEXTS]
    for block in (token_lengths.BLOCK, 3):
        rows = token_lengths.limits_table(histogram, block).collect()
        assert sorted(r["length"] for r in rows) == sorted(set(sizes))
        for r in rows:
            limit = r["length"]
            assert r["documents"] == sizes.count(limit) and r["total_tokens"] == sum(sizes)
            assert r["documents_up_to"] == sum(s <= limit for s in sizes) == len(sizes) - r["documents_over"]
            assert r["tokens_up_to"] == sum(s for s in sizes if s <= limit)
            assert r["tokens_truncated"] == sum(min(s, limit) for s in sizes) == sum(sizes) - r["tokens_lost"]
    cut = {r["limit"]: tuple(r)[1:] for r in token_lengths.truncated_total(histogram, [0, 5, 10**9]).collect()}
    assert cut == {n: (sum(min(s, n) for s in sizes), sum(s > n for s in sizes)) for n in (0, 5, 10**9)}
    limits = token_lengths.limits_table(histogram)
    assert token_lengths.quantile(limits, 0.5).first()["length"] == sorted(sizes)[-(-len(sizes) // 2) - 1]
    assert token_lengths.limits_table(token_lengths.length_histogram(frame.limit(0))).count() == 0
