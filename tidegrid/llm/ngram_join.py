"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence with itself.

Rows of the incidence are distinct n-gram sets (documents of one set share a row), columns are n-gram hashes (64 bits).

1. ``profile``: one pass gives every document its set size and fingerprint, and a sketch of column frequencies of fixed size.
2. ``prefix``: columns are ordered from rare to frequent by the sketch. Two sets that reach the threshold must share a column
   among the first ``n - ceil(t * n) + 1`` of each; only those enter the product. The order changes the work, never the result.
3. Column blocks: a shuffle by column; per column the list of its rows. Lists of one row end here.
4. Row by hub: in each list the set in which the column comes earliest (few rarer columns: a central text) is paired with the
   others, which is linear in the list. Overlaps of these pairs are counted exactly and links joined into components.
5. What is left are pairs of different components. Lists are blocked by hub, counts are accumulated inside the block, and a
   pair is discarded if its count, the columns it may share elsewhere and the suffix bound stay below the overlap its sizes
   ask for. The counts of the survivors are summed over the blocks, which gives the overlap of the prefixes, and pairs are
   discarded by the same bound again. Only then overlaps are counted exactly over the whole sets.

A link inside a component already found is never counted again, so groups of near copies do not become all their pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.components import components
from tidegrid.llm.tables import Scratch, batch_of, only, stored, unused
from tidegrid.llm.words import SPACE, Splitter, shingle_sets

#: Counters of the frequency sketch, fixed at every size of input (2**23 counters, 8 MB once they are levels).
SKETCH_BITS = 23
SKETCH_PARTS = 64
#: Sets compared with one hub in one go, and sets of one hub block that are compared with the block's lists.
PER_HUB = 512
#: Up to so many sets (16 bytes each) are looked up in a broadcast table; beyond, texts and look-ups are shuffled.
BROADCAST_SETS = 500_000
ROWS_PER_BLOCK = 1024

_MASK = np.uint64((1 << SKETCH_BITS) - 1)
_PART = (1 << SKETCH_BITS) // SKETCH_PARTS

PROFILE = "id long, n long, node long, part int, counts binary"
ENTRY = "gram long, node long, n int, place int"
LISTED = "gram long, node long, n int, hub long, members int"


def _fingerprint(found: np.ndarray) -> int:
    """One 64-bit name per set; the empty set has none."""
    weights = np.arange(1, len(found) + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F) | np.uint64(1)
    total = int(np.sum((found ^ (found >> np.uint64(29))) * weights, dtype=np.uint64))
    total = (total ^ (total >> 32)) * 0xD6E8FEB86659FD93 & (2**64 - 1)
    return int(np.uint64(total ^ (total >> 29) ^ len(found)).astype(np.int64))


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    splitter = Splitter(SPACE)
    for first, words in splitter.batches(batch.column("text")):
        yield from enumerate(shingle_sets(words, size), first)


def _packed(counts: np.ndarray) -> bytes:
    """One byte per counter and the large ones apart, compressed: most counters of a task are small."""
    large = np.flatnonzero(counts > 255)
    head = np.array([len(large)], dtype=np.int64).tobytes() + large.astype(np.int64).tobytes() + counts[large].astype(np.int64).tobytes()
    return zlib.compress(head + np.minimum(counts, 255).astype(np.uint8).tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    data = zlib.decompress(packed)
    many = int(np.frombuffer(data, np.int64, 1)[0])
    counts = np.frombuffer(data, np.uint8, offset=8 + 16 * many).astype(np.int64)
    counts[np.frombuffer(data, np.int64, many, 8)] = np.frombuffer(data, np.int64, many, 8 + 8 * many)
    return counts


def _profile(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)

        def add(waiting: list[np.ndarray]) -> None:
            place, times = np.unique(np.concatenate(waiting), return_counts=True)
            counts[place] += np.minimum(times, 2**31 - 1 - counts[place].astype(np.int64)).astype(np.int32)

        for batch in batches:
            sizes = np.zeros(batch.num_rows, dtype=np.int64)
            nodes = np.zeros(batch.num_rows, dtype=np.int64)
            waiting: list[np.ndarray] = []
            held = 0
            for row, found in _sets(batch, size):
                sizes[row] = len(found)
                if len(found):
                    nodes[row] = _fingerprint(found)
                    waiting.append((found & _MASK).astype(np.int32))
                    held += len(found)
                    if held > 1 << 20:
                        add(waiting)
                        waiting, held = [], 0
            if waiting:
                add(waiting)
            none = batch.num_rows
            yield batch_of(
                id=batch.column("id"),
                n=pa.array(sizes),
                node=pa.array(nodes, mask=sizes == 0),
                part=pa.nulls(none, pa.int32()),
                counts=pa.nulls(none, pa.binary()),
            )
        if counts.any():
            yield batch_of(
                id=pa.nulls(SKETCH_PARTS, pa.int64()),
                n=pa.nulls(SKETCH_PARTS, pa.int64()),
                node=pa.nulls(SKETCH_PARTS, pa.int64()),
                part=pa.array(range(SKETCH_PARTS), pa.int32()),
                counts=pa.array([_packed(row) for row in counts.reshape(SKETCH_PARTS, _PART)], pa.binary()),
            )

    return run


def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the sketch parts of one partition."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts"), strict=True):
            row = _unpacked(counts.as_py())
            sums[part] = sums[part] + row if part in sums else row
    if sums:
        levels = [np.round(4 * np.log2(row + 1.0)).astype(np.uint8).tobytes() for row in sums.values()]
        yield batch_of(part=pa.array(list(sums), pa.int32()), counts=pa.array(levels, pa.binary()))


def _levels(profile: DataFrame) -> bytes:
    """The sketch as one byte per counter, a quarter of a power of two each: SKETCH_PARTS rows of fixed size for the driver."""
    parts = profile.filter("part IS NOT NULL").select("part", "counts").repartition(SKETCH_PARTS, "part")
    rows = parts.mapInArrow(_add_counts, "part int, counts binary").collect()
    levels = np.zeros((SKETCH_PARTS, _PART), dtype=np.uint8)
    for row in rows:
        levels[row["part"]] = np.frombuffer(row["counts"], dtype=np.uint8)
    return levels.tobytes()


def _ceil_share(n, percent: int):
    """ceil(percent / 100 * n) in whole numbers."""
    return -(-percent * n // 100)


def _prefix(size: int, percent: int, levels, passes: int, turn: int):
    """The entries of the prefixes whose columns belong to this turn of so many passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(levels.value, dtype=np.uint8)
        seen: set[int] = set()
        for batch in batches:
            grams, nodes, sizes, places = [], [], [], []
            held = 0
            for _, found in _sets(batch, size):
                n = len(found)
                if not n or (node := _fingerprint(found)) in seen:
                    continue
                seen.add(node)
                length = n - _ceil_share(n, percent) + 1
                level = order[(found & _MASK).astype(np.int64)]
                prefix = found[np.argsort(level, kind="stable")[:length]]
                place = np.flatnonzero((prefix >> np.uint64(40)) % np.uint64(passes) == turn).astype(np.int32)
                grams.append(prefix[place])
                nodes.append(np.full(len(place), node, dtype=np.int64))
                sizes.append(np.full(len(place), n, dtype=np.int32))
                places.append(place)
                held += len(place)
                if held > 1 << 16:
                    yield _entries(grams, nodes, sizes, places)
                    grams, nodes, sizes, places = [], [], [], []
                    held = 0
            if held:
                yield _entries(grams, nodes, sizes, places)

    return run


def _entries(grams, nodes, sizes, places) -> pa.RecordBatch:
    return batch_of(
        gram=pa.array(np.concatenate(grams).view(np.int64)),
        node=pa.array(np.concatenate(nodes)),
        n=pa.array(np.concatenate(sizes)),
        place=pa.array(np.concatenate(places)),
    )


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and length of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.concatenate([first, [len(keys)]]))


def _column_block(percent: int):
    """One block of columns: the lists of two and more rows, each with its hub.

    A row stays in a list only if some other row of it has a size that allows a link; then its neighbour by size does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        gram, node, n, place = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(4))
        del got
        order = np.argsort(gram, kind="stable")
        length = _runs(gram[order])[1]
        order = order[np.repeat(length > 1, length)]
        if not len(order):
            return
        # the same set from several tasks counts once
        order = order[np.lexsort((node[order], n[order], gram[order]))]
        gram, node, n, place = gram[order], node[order], n[order], place[order]
        first = np.ones(len(gram), dtype=bool)
        first[1:] = (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])
        gram, node, n, place = gram[first], node[first], n[first].astype(np.int64), place[first]
        near = (gram[1:] == gram[:-1]) & (100 * n[:-1] >= percent * n[1:])
        keep = np.append(near, False) | np.append([False], near)
        if not keep.any():
            return
        gram, node, n, place = gram[keep], node[keep], n[keep], place[keep]
        order = np.lexsort((node, place, gram))
        gram, node, n = gram[order], node[order], n[order].astype(np.int32)
        start, length = _runs(gram)
        hub, members = np.repeat(node[start], length), np.repeat(length, length).astype(np.int32)
        for at in range(0, len(gram), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield batch_of(
                gram=pa.array(gram[part]),
                node=pa.array(node[part]),
                n=pa.array(n[part]),
                hub=pa.array(hub[part]),
                members=pa.array(members[part]),
            )

    return run


def _needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b that makes a link: 100 * x >= percent * (a + b - x)."""
    return -(-percent * (a + b) // (100 + percent))


def _row_blocks(percent: int):
    """Blocks of (hub, salt): pairs of different components that the accumulated counts do not rule out.

    ``common`` is what the pair shares in the lists of the hub, ``lack`` the least that it has to share in all lists: two sets share
    at most that and the longer suffix behind their prefixes.
    """

    def pairs_of(hub: int, block: dict[str, np.ndarray]) -> pa.RecordBatch | None:
        stray = block["row"]
        if not stray.any():
            return None
        nodes, at = np.unique(block["node"], return_index=True)
        place = np.searchsorted(nodes, block["node"])
        n, total, root = block["n"][at].astype(np.int64), block["lists"][at], block["root"][at]
        here = np.bincount(place, minlength=len(nodes))
        elsewhere = total - here
        suffix = _ceil_share(n, percent) - 1
        rows = np.unique(place[stray])
        row_of = np.full(len(nodes), -1)
        row_of[rows] = np.arange(len(rows))
        found = []
        order = np.argsort(block["gram"], kind="stable")
        place = place[order]
        first, length = _runs(block["gram"][order])
        step = max(1, (1 << 24) // len(nodes))
        for low in range(0, len(rows), step):
            counts = np.zeros((min(step, len(rows) - low), len(nodes)), dtype=np.int32)
            for start, count in zip(first.tolist(), length.tolist(), strict=True):
                members = place[start : start + count]
                own = row_of[members] - low
                own = own[(row_of[members] >= 0) & (own >= 0) & (own < len(counts))]
                counts[np.ix_(own, members)] += 1
            mine, other = np.nonzero(counts)
            a, b = rows[mine + low], other
            common = counts[mine, other]
            lack = _needed(n[a], n[b], percent) - np.maximum(suffix[a], suffix[b])
            sizes_fit = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            keep = (root[a] != root[b]) & sizes_fit & (common + np.minimum(elsewhere[a], elsewhere[b]) >= lack)
            low_node, high_node = np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])
            found.append([x[keep] for x in (low_node, high_node, common.astype(np.int64), lack)])
        a, b, common, lack = (np.concatenate(x) for x in zip(*found, strict=True))
        if not len(a):
            return None
        return batch_of(
            block=pa.array(np.full(len(a), hub)), hub=pa.array(a), node=pa.array(b), common=pa.array(common), lack=pa.array(lack)
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        key = None

        def close() -> Iterator[pa.RecordBatch]:
            if held and (out := pairs_of(key[0], {k: np.concatenate([x[k] for x in held]) for k in held[0]})) is not None:
                yield out

        for batch in batches:
            columns = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
            changed = (columns["hub"][1:] != columns["hub"][:-1]) | (columns["salt"][1:] != columns["salt"][:-1])
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for first, last in zip(edges[:-1], edges[1:], strict=True):
                if first == last:
                    continue
                now = (int(columns["hub"][first]), int(columns["salt"][first]))
                if now != key:
                    yield from close()
                    held, key = [], now
                held.append({k: v[first:last] for k, v in columns.items()})
        yield from close()

    return run


def _count_overlaps(percent: int):
    """Rows sorted by (hub, salt, role): the hub's set, then the sets paired with it; gives the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub_set = None, None
        for batch in batches:
            left, right = [], []
            columns = (batch.column(k) for k in ("hub", "salt", "node", "role", "grams"))
            for hub, salt, node, role, grams in zip(*(c.to_pylist() for c in columns), strict=True):
                found = np.frombuffer(grams, dtype=np.uint64)
                if role == 0:
                    key, hub_set = (hub, salt), found
                    continue
                if key != (hub, salt):
                    raise ValueError("a set came without its hub")
                small, large = (found, hub_set) if len(found) < len(hub_set) else (hub_set, found)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int(np.count_nonzero(large[at] == small))
                if 100 * common >= percent * (len(small) + len(large) - common):
                    left.append(hub)
                    right.append(node)
            yield batch_of(a=pa.array(left, pa.int64()), b=pa.array(right, pa.int64()))

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("node").to_pylist()
            nodes, grams = [], []
            for row, found in _sets(batch, size):
                if len(found) and _fingerprint(found) == wanted[row]:
                    nodes.append(wanted[row])
                    grams.append(found.tobytes())
                if len(nodes) >= 500:
                    yield batch_of(node=pa.array(nodes, pa.int64()), grams=pa.array(grams, pa.binary()))
                    nodes, grams = [], []
            yield batch_of(node=pa.array(nodes, pa.int64()), grams=pa.array(grams, pa.binary()))

    return run


class NgramJaccardJoin:
    """The join over ``id, text`` rows. ``percent``: the least similarity, in hundredths; ``size``: words per n-gram.

    ``passes``: the columns are shuffled in so many parts, one after the other, each of which reads the texts again; the disk that
    the shuffle needs shrinks by as much. The result is the same.
    """

    def __init__(self, documents: DataFrame, size: int = 5, percent: int = 75, passes: int = 1):
        if size < 1 or not 1 <= percent <= 100 or passes < 1:
            raise ValueError("size and passes are at least 1, percent from 1 to 100")
        self.size, self.percent, self.passes = size, percent, passes
        self.documents = documents
        self.spark = documents.sparkSession
        self.scratch = Scratch(self.spark)
        self.profile = self.scratch.stored(documents.mapInArrow(_profile(size), PROFILE), "profile")
        self.rows = self.profile.filter("part IS NULL")
        self.holders = self.rows.filter("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"))

    def lists(self, scratch: Scratch) -> DataFrame:
        """The incidence entries of columns that occur in the prefixes of several sets."""
        levels = self.spark.sparkContext.broadcast(_levels(self.profile))
        named = self.documents.filter("id IS NOT NULL")
        parts = []
        for turn in range(self.passes):
            prefix = _prefix(self.size, self.percent, levels, self.passes, turn)
            entries = named.mapInArrow(prefix, ENTRY).repartition("gram")
            parts.append(scratch.stored(entries.mapInArrow(_column_block(self.percent), LISTED), "lists"))
        levels.destroy()
        return reduce(DataFrame.union, parts)

    def links(self, pairs: DataFrame, label: str) -> DataFrame:
        """``hub, node`` pairs -> the pairs ``a, b`` that reach the threshold, by exact counts over the whole sets."""
        scratch = Scratch(self.spark)
        pairs = scratch.stored(pairs, f"pairs-{label}")
        both = pairs.select("node").union(pairs.select(F.col("hub").alias("node"))).distinct()
        wanted = scratch.stored(self.holders.join(both, "node").select("id", "node"), f"wanted-{label}")
        few = wanted.count() <= BROADCAST_SETS
        texts = self.documents.join(F.broadcast(wanted) if few else wanted, "id")
        sets = texts.mapInArrow(_whole_sets(self.size), "node long, grams binary").dropDuplicates(["node"])
        sizes = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_HUB).cast("int").alias("salts"))
        salted = pairs.join(sizes, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
        members = salted.select("hub", "salt", "node", F.lit(1).alias("role"))
        heads = salted.select("hub", "salt").distinct().select("hub", "salt", F.col("hub").alias("node"), F.lit(0).alias("role"))
        # members and heads ask for their sets in one join, by which the sets are already dealt
        asked = scratch.stored(members.union(heads), f"asked-{label}")
        grouped = sets.join(asked, "node").select("hub", "salt", "node", "role", "grams")
        grouped = grouped.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
        links = stored(grouped.mapInArrow(_count_overlaps(self.percent), "a long, b long"), f"links-{label}")
        scratch.clear()
        return links

    def hub_pairs(self, lists: DataFrame, scratch: Scratch) -> DataFrame:
        """Every set of a list with the list's hub, once, if sizes and counts allow a link.

        What two sets share is at most the fewer lists of either and the longer suffix behind the prefixes.
        """
        of_pair = lists.filter("hub <> node").select("hub", "node").distinct()
        of_node = scratch.stored(lists.groupBy("node").agg(F.max("n").alias("n"), F.count("*").alias("lists")), "nodes")
        hubs = of_node.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("lists").alias("hub_lists"))
        pairs = of_pair.join(of_node, "node").join(hubs, "hub")
        share = self.percent
        fit = F.expr(f"100 * least(n, hub_n) >= {share} * greatest(n, hub_n)")
        suffix = f"ceil({share} * greatest(n, hub_n) / 100) - 1"
        needed = f"ceil({share} * (n + hub_n) / {100 + share})"
        return pairs.filter(fit).filter(f"least(lists, hub_lists) + {suffix} >= {needed}").select("hub", "node")

    def cross_pairs(self, lists: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
        """Pairs of sets of different components that share a column and that the counts do not rule out.

        A list of two sets has no pair without its hub, so only longer lists are looked at.
        """
        lists_of = lists.groupBy("node").agg(F.count("*").alias("lists"))
        about = lists_of.join(roots, "node", "left").select("node", "lists", F.coalesce("root", "node").alias("root"))
        listed = scratch.stored(lists.filter("members > 2").join(about, "node"), "rooted")
        shares = listed.groupBy("hub", "gram", "root").agg(F.count("*").alias("k"))
        main = shares.groupBy("hub", "gram").agg(F.max(F.struct("k", "root")).alias("m"), F.count("*").alias("roots"))
        mixed = main.filter("roots > 1").select("hub", "gram", F.col("m.root").alias("main"))
        rows = scratch.stored(listed.join(mixed, ["hub", "gram"]).withColumn("stray", F.expr("root <> main")).drop("main"), "mixed")
        salts = rows.filter("stray").groupBy("hub").agg(
            F.ceil(F.approx_count_distinct("node") / ROWS_PER_BLOCK).cast("int").alias("salts")
        )
        spread = rows.join(salts, "hub").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        mine = F.expr("stray AND pmod(xxhash64(node), salts) = salt").alias("row")
        blocks = spread.select("hub", "salt", "gram", "node", "n", "lists", "root", mine)
        blocks = blocks.repartition("hub", "salt").sortWithinPartitions("hub", "salt")
        counted = blocks.mapInArrow(_row_blocks(self.percent), "block long, hub long, node long, common long, lack long")
        # two blocks of a hub give a pair of strays the same count
        once = counted.dropDuplicates(["block", "hub", "node"])
        sums = once.groupBy("hub", "node").agg(F.sum("common").alias("common"), F.max("lack").alias("lack"))
        return sums.filter("common >= lack").select("hub", "node")

    def roots(self) -> DataFrame:
        """``node, root`` for every set that is linked with another one and is not the root itself."""
        scratch = Scratch(self.spark)
        lists = self.lists(scratch)
        near = self.links(self.hub_pairs(lists, scratch), "hub")
        far = self.links(self.cross_pairs(lists, components(near), scratch), "cross")
        scratch.clear()
        return components(near.union(far))

    def classes(self) -> DataFrame:
        """``id, n_shingles, component_id``: one row per input row, see ``ngram_jaccard_components``."""
        nodes = self.holders.join(self.roots(), "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
        least = nodes.groupBy("root").agg(F.min("id").alias("component_id"))
        of_node = nodes.join(least, "root").select("node", "component_id")
        rows = self.rows.join(of_node, "node", "left")
        named = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
        return rows.select("id", F.col("n").alias("n_shingles"), named.alias("component_id"))


def ngram_jaccard_components(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document; see the module for the method.

    Null, empty or blank texts have an empty set and are alone. Rows without an id keep their size and have a null component:
    they cannot be named by others. Repeated rows, ties and copies fall into one component. Rows that share an id with
    different texts are one vertex per text under the same id. An empty table gives an empty table; other columns are ignored.
    """
    plain = only(documents, [id_column, text_column]).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    return NgramJaccardJoin(plain).classes().withColumnRenamed("id", id_column)


def without_near_copies(documents: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest id, with all columns of the table.

    Rows without an id are in no component and stay. Of rows that share an id one stays.
    """
    classes = ngram_jaccard_components(documents)
    dropped = stored(classes.filter("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    few = dropped.count() <= BROADCAST_SETS
    kept = documents.join(F.broadcast(dropped) if few else dropped, "doc_id", "left_anti").select(*documents.columns)
    repeated = stored(kept.groupBy("doc_id").count().filter("count > 1 AND doc_id IS NOT NULL").select("doc_id"), "repeated")
    count = repeated.count()
    if not count:
        return kept
    again = F.broadcast(repeated) if count <= BROADCAST_SETS else repeated
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").unionByName(once.select(*kept.columns))


def one_row_of_each_component(documents: DataFrame, passes: int = 2) -> DataFrame:
    """Exactly one row of each component of texts stays, with all columns of the table; the pipeline's stage.

    Rows are told apart by a number, given when the input is stored, so it does not matter whether they have an id or share it.
    The row with the smallest id stays, one without an id only if no row of the component has one. Texts without words are alone.
    The numbered copy of the input takes as much disk as the input, so columns are shuffled in two passes; what the result
    does not read is deleted.
    """
    row = unused(documents, "row")
    numbered = stored(documents.withColumn(row, F.monotonically_increasing_id()), "numbered")
    join, scratch = NgramJaccardJoin(numbered.select(F.col(row).alias("id"), "text"), passes=passes), Scratch(documents.sparkSession)
    about = scratch.stored(join.classes().join(numbered.select(F.col(row).alias("id"), "doc_id"), "id"), "about")
    join.scratch.clear()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "id")).alias("first")
    staying = about.groupBy("component_id").agg(first).select(F.col("first.id").alias("id"))
    dropped = stored(about.join(staying, "id", "left_anti").select(F.col("id").alias(row)), "dropped")
    scratch.clear()
    few = dropped.count() <= BROADCAST_SETS
    kept = numbered.join(F.broadcast(dropped) if few else dropped, row, "left_anti")
    return only(kept, documents.columns)
