"""Chains of landed news pages: order of files, broken chains, batches and restarts."""

import json
import random

import pytest

from tidegrid.sources import paging
from tidegrid.streaming import paging as live


def chain(symbol, pages, per_page=2, base=0):
    """Pages of a chain; the cursors do not tell their order."""
    def cursor(i):
        return f"{symbol}-{(i * 7919 + 13) % 100_003}" if i else None

    return [
        {
            "symbol": symbol,
            "page_token": cursor(i),
            "news": [
                {"id": base + per_page * i + j, "created_at": "2024-01-02T03:04:05Z", "headline": "h", "content": None, "symbols": [symbol]}
                for j in range(per_page)
            ],
            "next_page_token": cursor(i + 1) if i + 1 < pages else None,
        }
        for i in range(pages)
    ]


def land(folder, name, pages):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(page) + "\n" for page in pages))


def places(df):
    return sorted((r["symbol"], r["article_id"], r["page"], r["place"]) for r in df.collect())


def wanted(symbol, pages, per_page=2, base=0):
    return [(symbol.upper(), base + per_page * i + j, i, j) for i in range(pages) for j in range(per_page)]


def test_pages_in_any_file_and_order(spark, tmp_path):
    pages = chain("hot", 70) + chain("a", 1, base=1000) + chain("b", 9, base=2000)
    random.Random(3).shuffle(pages)
    for part in range(5):
        land(tmp_path / "in", part, pages[part::5])
    found = places(paging.read_news_chain(spark, str(tmp_path / "in")))
    assert found == sorted(wanted("hot", 70) + wanted("a", 1, base=1000) + wanted("b", 9, base=2000))


def test_pages_landed_twice_count_once_and_empty_pages_keep_the_chain(spark, tmp_path):
    pages = chain("x", 4)
    pages[2]["news"] = []
    pages[3]["next_page_token"] = ""
    land(tmp_path / "in", 0, pages + pages[1:3])
    assert places(paging.read_news_chain(spark, str(tmp_path / "in"))) == [r for r in wanted("x", 4) if r[2] != 2]


def test_no_pages(spark, tmp_path):
    land(tmp_path / "in", 0, [])
    assert paging.read_news_chain(spark, str(tmp_path / "in")).count() == 0


def _without(pages, *places):
    return [page for i, page in enumerate(pages) if i not in places]


def _ring(pages):
    return [dict(pages[1], next_page_token="r"), dict(pages[2], page_token="r", next_page_token=pages[1]["page_token"])]


@pytest.mark.parametrize(
    ("made", "message"),
    [
        (lambda: _without(chain("x", 6), 3), "missing pages"),
        (lambda: _without(chain("x", 6), 5), "missing pages"),
        (lambda: _without(chain("x", 6), 0), "not reached"),
        (lambda: chain("y", 3) + _ring(chain("x", 3)), "not reached"),
        (lambda: [*chain("x", 3), dict(chain("x", 3)[1], news=[])], "different pages under one cursor"),
        (lambda: [*chain("x", 3), dict(chain("x", 3)[1], page_token="other")], "several pages lead to one cursor"),
        (lambda: [dict(chain("x", 1)[0], symbol=None)], "without a symbol"),
    ],
)
def test_broken_chains_are_errors(spark, tmp_path, made, message):
    land(tmp_path / "in", 0, made())
    with pytest.raises(ValueError, match=message):
        paging.read_news_chain(spark, str(tmp_path / "in"))


def follow(spark, tmp_path):
    live.follow_news_chain(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log"), 1).awaitTermination()


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_gives_pages_once_connected(spark, tmp_path, seed):
    """One file a batch, pages in mixed order, the stream started anew in between."""
    pages = chain("x", 8) + chain("z", 2, base=500)
    random.Random(seed).shuffle(pages)
    for part in range(2):
        land(tmp_path / "in", part, pages[part::4])
    follow(spark, tmp_path)
    early = places(live.followed_news(spark, str(tmp_path / "out")))
    have = {page["news"][0]["id"] for part in range(2) for page in pages[part::4]}
    linked = []
    for symbol, count, base in (("x", 8, 0), ("z", 2, 500)):
        ready = 0
        while ready < count and base + 2 * ready in have:
            ready += 1
        linked += wanted(symbol, ready, base=base)
    assert early == sorted(linked)
    for part in range(2, 4):
        land(tmp_path / "in", part, [*pages[part::4], pages[0]])
    follow(spark, tmp_path)
    assert places(live.followed_news(spark, str(tmp_path / "out"))) == sorted(wanted("x", 8) + wanted("z", 2, base=500))
    assert live.open_chains(spark, str(tmp_path / "out")).count() == 0


def test_a_repeated_batch_writes_the_same(spark, tmp_path):
    pages = chain("x", 4)
    schema = paging.CHAINED_PAGE
    for batch_id, part in ((0, pages[:1]), (1, pages[2:]), (1, pages[2:]), (2, pages[1:2]), (2, pages[1:2])):
        live.take_batch(spark.createDataFrame(part, schema), batch_id, str(tmp_path / "out"))
        if batch_id == 1:
            assert places(live.followed_news(spark, str(tmp_path / "out"))) == wanted("x", 1)
            assert live.open_chains(spark, str(tmp_path / "out")).select("symbol", "pages").collect() == [("X", 1)]
    assert places(live.followed_news(spark, str(tmp_path / "out"))) == wanted("x", 4)


def test_another_page_under_a_known_cursor_is_an_error(spark, tmp_path):
    pages = chain("x", 3)
    live.take_batch(spark.createDataFrame(pages[:2], paging.CHAINED_PAGE), 0, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="different pages"):
        live.take_batch(spark.createDataFrame([dict(pages[1], news=[])], paging.CHAINED_PAGE), 1, str(tmp_path / "out"))


def test_pages_are_written_once_while_they_wait_and_never_dealt(spark, tmp_path, monkeypatch):
    """Three batches, last pages first; a page that waits lands again, and one twice in a batch."""
    from pyspark.sql import DataFrameWriter

    plans, write = {}, DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, at, **o: (plans.update({at[len(str(tmp_path)) :]: w._df._jdf.queryExecution().executedPlan().toString()}), write(w, at, **o))[1])
    pages = chain("x", 12)
    for batch_id, part in enumerate((pages[8:], pages[4:9], [*pages[:4], pages[2], pages[9]])):
        live.take_batch(spark.createDataFrame(part, paging.CHAINED_PAGE), batch_id, str(tmp_path / "out"))
    assert places(live.followed_news(spark, str(tmp_path / "out"))) == sorted(wanted("x", 12))
    waited = spark.read.parquet(str(tmp_path / "out" / "waiting")).groupBy("batch").count().collect()
    assert {r["batch"]: r["count"] for r in waited} == {0: 4, 1: 4}
    for table in ("news", "waiting"):
        assert "hashpartitioning" not in plans[f"/out/{table}/batch=1"] and "BroadcastHashJoin" in plans[f"/out/{table}/batch=1"]


def test_many_links_are_joined_by_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "MOST_SENT_LINKS", 0)
    pages = chain("x", 6) + chain("z", 3, base=500)
    for batch_id, part in enumerate((pages[1::2], pages[::2])):
        live.take_batch(spark.createDataFrame(part, paging.CHAINED_PAGE), batch_id, str(tmp_path / "out"))
    assert places(live.followed_news(spark, str(tmp_path / "out"))) == sorted(wanted("x", 6) + wanted("z", 3, base=500))
