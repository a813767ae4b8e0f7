"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index stores where the terms of the benchmark stand in the training texts: ``word, row, pos``, and per text one posting of the
empty word at its end, which keeps its id and length. Windows of the benchmark are looked up from their rarest term: its list,
moved back by the term's offset, gives possible starts; the list of the second rarest term, moved likewise, leaves few of them;
the remaining lists decide. With a slack, a posting may stand so many words off its place (proximity instead of phrase).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.tables import only, stored, unused

WINDOW = 10
#: Up to so many rows (terms, windows, texts with matches) a lookup table is broadcast; beyond, the join is shuffled.
BROADCAST_ROWS = 500_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; of a null, none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), SEPARATORS), "")


def _small(df: DataFrame) -> DataFrame:
    """A stored table, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


class BenchmarkWindows:
    """The distinct windows of a benchmark (``wid, terms``) and the items they are from (``wid, item_id``)."""

    def __init__(self, benchmark: DataFrame, window: int = WINDOW):
        items = only(benchmark, ["item_id", "text"]).filter("item_id IS NOT NULL")
        items = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words"))
        size = F.least(F.size("words"), F.lit(window))
        starts = F.sequence(F.lit(1), F.size("words") - size + 1)
        cut = items.filter(F.size("words") > 0).select(
            "item_id", F.explode(F.transform(starts, lambda s: F.slice(F.col("words"), s, size))).alias("terms")
        )
        cut = stored(cut.distinct(), "cut")
        self.windows = stored(cut.select("terms").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
        self.members = stored(cut.join(self.windows, "terms").select("wid", "item_id"), "members")
        self.vocabulary = stored(self.windows.select(F.explode("terms").alias("word")).distinct(), "vocabulary")


class PositionalIndex:
    """Postings of a vocabulary in the texts of ``documents`` (``doc_id, text``)."""

    def __init__(self, documents: DataFrame, vocabulary: DataFrame):
        end = documents.sparkSession.createDataFrame([("",)], "word string")
        terms = stored(vocabulary.select("word").union(end).distinct(), "terms")
        rows = only(documents, ["doc_id", "text"]).withColumn("row", F.monotonically_increasing_id())
        found = F.posexplode(F.concat(words(F.col("text")), F.array(F.lit("")))).alias("pos", "word")
        every = rows.select("doc_id", "row", found)
        named = F.when(F.col("word") == "", F.col("doc_id")).alias("doc_id")
        self.stored = stored(every.join(_small(terms), "word").select("word", "row", "pos", named), "postings")
        self.postings = self.stored.filter("word <> ''").select("word", "row", "pos")
        self.texts = self.stored.filter("word = ''").select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))

    def ordered(self, windows: DataFrame) -> DataFrame:
        """``wid, terms``, each window's terms as (frequency, offset, word), rarest first; windows with an absent
        term cannot occur and are left out."""
        frequency = self.postings.groupBy("word").agg(F.count("*").alias("frequency"))
        places = windows.select("wid", F.size("terms").alias("size"), F.posexplode("terms").alias("at", "word"))
        known = places.join(frequency, "word")
        terms = F.sort_array(F.collect_list(F.struct("frequency", "at", "word"))).alias("terms")
        whole = known.groupBy("wid", "size").agg(terms).filter(F.size("terms") == F.col("size"))
        return stored(whole.select("wid", "size", "terms"), "ordered")

    def _near(self, starts: DataFrame, ordered: DataFrame, nth: int, slack: int) -> DataFrame:
        """The starts at which the n-th rarest term of the window stands within the slack of its place, too."""
        term = ordered.filter(F.size("terms") > nth).select("wid", F.col("terms")[nth].alias("t"))
        wanted = starts.join(_small(stored(term, "term")), "wid")
        own = F.col("start") + F.col("t.at")
        wanted = wanted.select("row", "wid", "start", F.col("t.word").alias("word"), own.alias("own"))
        if slack:
            moved = F.explode(F.sequence(F.col("own") - slack, F.col("own") + slack)).alias("pos")
            wanted = wanted.select("row", "wid", "start", "word", moved)
        else:
            wanted = wanted.withColumnRenamed("own", "pos")
        used = _small(stored(term.select("t.word").distinct(), "used"))
        lists = self.postings.join(used, "word", "left_semi")
        return wanted.join(lists, ["row", "pos", "word"], "left_semi").select("row", "wid", "start").distinct()

    def matches(self, windows: DataFrame, slack: int = 0) -> DataFrame:
        """``row, wid, start, size``: where windows occur; with a slack, ``start`` is where the rarest term puts it."""
        ordered = self.ordered(windows)
        sizes = ordered.select("wid", "size")
        first = ordered.select("wid", F.col("terms")[0]["word"].alias("word"), F.col("terms")[0]["at"].alias("at"))
        starts = self.postings.join(_small(stored(first, "first")), "word")
        starts = starts.select("row", "wid", (F.col("pos") - F.col("at")).alias("start"))
        starts = starts if slack else starts.filter("start >= 0")
        single = ordered.filter("size = 1").select("wid")
        alone = starts.join(single, "wid", "left_semi")
        left = stored(self._near(starts, ordered, 1, slack), "starts")
        rest = self._decided(left, ordered, slack)
        return alone.unionByName(rest).join(sizes, "wid").select("row", "wid", "start", F.col("size").cast("int").alias("size"))

    def _decided(self, starts: DataFrame, ordered: DataFrame, slack: int) -> DataFrame:
        """The starts at which all terms from the third rarest on are found, from the lists of the texts that are left."""
        texts = stored(starts.select("row").distinct(), "texts")
        lists = self.postings.join(_small(texts), "row", "left_semi")
        further = ordered.select("wid", "size", F.expr("slice(terms, 3, size)").alias("more"))
        wide = starts.join(_small(stored(further, "further")), "wid")
        done = wide.filter("size <= 2").select("row", "wid", "start")
        wanted = wide.filter("size > 2").select("row", "wid", "start", "size", F.explode("more").alias("t"))
        own = F.col("start") + F.col("t.at")
        pos = F.explode(F.sequence(own - slack, own + slack)) if slack else own
        wanted = wanted.select("row", "wid", "start", "size", F.col("t.word").alias("word"), F.col("t.at").alias("at"), pos.alias("pos"))
        hit = wanted.join(lists, ["row", "pos", "word"], "left_semi")
        seen = F.count_distinct("at") if slack else F.count("*")
        whole = hit.groupBy("row", "wid", "start").agg(seen.alias("seen"), F.first("size").alias("size"))
        return done.union(whole.filter("seen = size - 2").select("row", "wid", "start"))


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``: one row per row of ``documents``.

    Null and empty texts have no words and are clean, also with an empty benchmark. Items without an id or without words are
    left out, items that repeat with their id count once. Repeated documents (also under one id or none) are judged one by one.
    Other columns of either table are ignored.
    """
    cut = BenchmarkWindows(benchmark, window)
    index = PositionalIndex(documents, cut.vocabulary)
    found = stored(index.matches(cut.windows), "matches")
    spans = found.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    before = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(before), F.lit(0))
    fresh = spans.select("row", F.greatest(F.lit(0), F.col("end") - F.greatest("start", reached)).alias("fresh"))
    hits = fresh.groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    items = found.select("row", "wid").distinct().join(_small(cut.members), "wid").groupBy("row")
    named = items.agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    about = hits.join(named, "row")
    nothing = F.array().cast("array<string>")
    judged = index.texts.join(about, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", nothing)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", nothing), ","), 256).alias("items_sha256"),
    )
    return judged.withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose text holds no window of the benchmark, with all columns.

    The ids of contaminated documents are removed; rows without an id cannot be named by another one and are kept.
    """
    bad = contamination(documents, benchmark).filter("contaminated AND doc_id IS NOT NULL").select("doc_id").distinct()
    return documents.join(_small(stored(bad, "contaminated")), "doc_id", "left_anti").select(*documents.columns)


def clean_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Drops exactly the rows whose text holds a window of the benchmark, with all columns; the pipeline's stage.

    Whether a row is contaminated depends on its text alone, so rows are found again by the SHA-256 of the text: those without an
    id are dropped, too, and a clean text stays when another one of its id is dropped.
    """
    text_key = F.unhex(F.sha2(F.encode(F.col("text"), "UTF-8"), 256))
    judged = contamination(documents.select(text_key.alias("doc_id"), "text"), benchmark)
    name = unused(documents, "text_key")
    bad = stored(judged.filter("contaminated").select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    kept = documents.withColumn(name, text_key).join(_small(bad), name, "left_anti")
    return only(kept, documents.columns)
