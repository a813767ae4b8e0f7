"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is the sum of embeddings that are looked up by two hashes of the word and by hashes of its first bytes (for words of one
stem). Filters over one, two and three words, a maximum over all places of the text for each filter, and a logistic output.
Training sees a bounded sample
of labelled documents of the training folds; the score is calibrated on a part of it that the weights did not see, and per
language a threshold is calibrated there too. Every document is scored over its whole text: since a filter is linear, its
output at a place is a sum of rows of small tables, one per hash and offset, and no text is cut.

Score inputs are the words of the text alone; the language only selects the extra, calibrated decision ``flagged``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, only
from tidegrid.llm.words import PUNCTUATION, Splitter, Words, mix

#: At most so many labelled documents are trained on, chosen by a hash of their id; half of them, if there are, of label 1.
SAMPLE_DOCUMENTS = 10_000
#: Longer texts (in bytes) are not trained on, so the sample has a bound in bytes, too; all texts are scored whole.
LONGEST_TRAINED = 200_000
#: Fixed part of the contract: rows with this remainder of crc32(doc_id) by 3 are held out; scores from this are label 1.
HELD_OUT, FOLDS, TOXIC_FROM = 1, 3, 0.7

BUCKETS_LOG2 = 15
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: First bytes of a word that have an embedding of their own.
PREFIXES = (5, 7)
HASHES = 2 + len(PREFIXES)
CALIBRATION_SHARE = 0.2


def _buckets(words: Words) -> np.ndarray:
    """One row per hash: the bucket of each word."""
    drop = np.uint64(64 - BUCKETS_LOG2)
    hashes = [words.hashes, mix(words.hashes + np.uint64(0x51)), *[words.prefixes(size) for size in PREFIXES]]
    return np.stack([(h >> drop).astype(np.int32) for h in hashes])


@dataclass
class Network:
    """Weights; ``tables`` holds for each hash, width and offset what a bucket adds to the filters of that width."""

    embeddings: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    output: np.ndarray
    slope: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> list[list[np.ndarray]]:
        """[width][offset] -> per hash a table of buckets by filters."""
        return [[self.embeddings @ w[k] for k in range(w.shape[0])] for w in self.filters]

    def pooled(self, outputs: list[list[np.ndarray]], lengths: np.ndarray, places: bool = False):
        """Per text and filter the maximum over the places, after bias and rectifier; if asked, also where it is.

        ``outputs``: [width][offset] -> what each word adds to the filters; places past the end of a text add nothing.
        """
        best = np.zeros((len(lengths), len(self.bias)), dtype=np.float32)
        at = np.full(best.shape, -1)
        some = np.flatnonzero(lengths)
        if not len(some):
            return best, at
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[some]
        left = np.repeat(ends, lengths) - np.arange(ends[-1])
        for w, parts in enumerate(outputs):
            out = parts[0]
            for k in range(1, len(parts)):
                add = parts[k][k:]
                add[left[: len(add)] <= k] = 0
                out[: len(add)] += add
            columns = slice(w * FILTERS, (w + 1) * FILTERS)
            top = np.maximum.reduceat(out, starts, axis=0)
            best[some, columns] = np.maximum(top + self.bias[columns], 0)
            if places:
                hit = np.where(out == np.repeat(top, lengths[some], axis=0), np.arange(len(out))[:, None], len(out))
                at[some, columns] = np.where(top + self.bias[columns] > 0, np.minimum.reduceat(hit, starts, axis=0), -1)
        return best, at

    def logits(self, best: np.ndarray) -> np.ndarray:
        return best @ self.output[:-1] + self.output[-1]


def _outputs(tables: list[list[np.ndarray]], buckets: np.ndarray) -> list[list[np.ndarray]]:
    """What each word adds, summed over its hashes."""
    return [[sum(t[h][buckets[h]] for h in range(HASHES)) for t in parts] for parts in tables]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _start(rows: list[np.ndarray], labels: np.ndarray, seed: int) -> Network:
    """Random weights, but for the first embedding dimension: smoothed log odds of a bucket by document counts."""
    rng = np.random.default_rng(seed)
    size = 1 << BUCKETS_LOG2
    embeddings = rng.normal(0, 0.05, (HASHES, size, DIMENSIONS)).astype(np.float32)
    counts = np.zeros((2, HASHES, size))
    for row, label in zip(rows, labels.astype(int), strict=True):
        for h in range(HASHES):
            counts[label, h, np.unique(row[h])] += 1
    totals = np.array([max((labels == 0).sum(), 1), max((labels == 1).sum(), 1)])
    share = (counts + 0.5) / (totals[:, None, None] + 1)
    # a bucket of few documents says little: odds are drawn to zero
    weight = counts.sum(axis=0) / (counts.sum(axis=0) + 10.0)
    embeddings[:, :, 0] = np.clip(np.log(share[1] / share[0]) * weight, -3, 3) / 2
    filters = [rng.normal(0, 0.2, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for w in filters:
        w[0, 0, : FILTERS // 2] = np.abs(w[0, 0, : FILTERS // 2]) + 0.7
    bias = np.full(len(WIDTHS) * FILTERS, -0.5, dtype=np.float32)
    output = np.append(rng.normal(0.3, 0.1, len(bias)), -2.0).astype(np.float32)
    return Network(embeddings, filters, bias, output)


def train(rows: list[np.ndarray], labels: np.ndarray, rounds: int = 4, rate: float = 0.02, seed: int = 7) -> Network:
    """Adagrad over batches of documents; the gradient of a maximum goes to the words at its place."""
    net = _start(rows, labels, seed)
    rng = np.random.default_rng(seed + 1)
    squares = [np.full_like(x, 0.01) for x in (net.embeddings, net.bias, net.output, *net.filters)]
    positives = max((labels == 1).mean(), 1e-3)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), 64):
            chosen = order[first : first + 64]
            buckets = np.concatenate([rows[k] for k in chosen], axis=1)
            lengths = np.array([rows[k].shape[1] for k in chosen])
            vectors = sum(net.embeddings[h][buckets[h]] for h in range(HASHES))
            best, at = net.pooled([[vectors @ w[k] for k in range(len(w))] for w in net.filters], lengths, places=True)
            goal = labels[chosen]
            balance = np.where(goal == 1, 0.5 / positives, 0.5 / (1 - positives))
            error = ((_sigmoid(net.logits(best)) - goal) * balance).astype(np.float32)
            slope_o = np.append(error @ best, error.sum())
            back = np.where(at >= 0, error[:, None] * net.output[:-1], 0)
            slopes = [back.sum(axis=0), slope_o.astype(np.float32)]
            ends = np.repeat(np.cumsum(lengths)[:, None], FILTERS, axis=1)
            touched, pushed = [], []
            for w, weights in enumerate(net.filters):
                own, place = back[:, w * FILTERS : (w + 1) * FILTERS], at[:, w * FILTERS : (w + 1) * FILTERS]
                slope = np.zeros_like(weights)
                for k in range(len(weights)):
                    row, column = np.nonzero((place >= 0) & (place + k < ends))
                    word, strength = place[row, column] + k, own[row, column][:, None]
                    np.add.at(slope[k].T, column, strength * vectors[word])
                    touched.append(word)
                    pushed.append(strength * weights[k].T[column])
                slopes.append(slope)
            word, push = np.concatenate(touched), np.concatenate(pushed)
            for h in range(HASHES):
                seen, where = np.unique(buckets[h][word], return_inverse=True)
                slope = np.zeros((len(seen), DIMENSIONS), dtype=np.float32)
                np.add.at(slope, where, push)
                squares[0][h, seen] += slope**2
                net.embeddings[h, seen] -= rate * slope / np.sqrt(squares[0][h, seen])
            for value, slope, square in zip((net.bias, net.output, *net.filters), slopes, squares[1:], strict=True):
                square += slope**2
                value -= rate * slope / np.sqrt(square)
    return net


def raw_scores(net: Network, rows: list[np.ndarray]) -> np.ndarray:
    tables = net.tables()
    found = []
    for first in range(0, len(rows), 64):
        part = rows[first : first + 64]
        best, _ = net.pooled(_outputs(tables, np.concatenate(part, axis=1)), np.array([r.shape[1] for r in part]))
        found.append(net.logits(best))
    return np.concatenate(found) if found else np.zeros(0)


def calibrate(net: Network, raw: np.ndarray, labels: np.ndarray, languages: list[str | None]) -> None:
    """Platt scaling, and per language the threshold with the best F1 (the common one where a language has few of a label)."""
    slope, shift = 1.0, 0.0
    goal = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
    for _ in range(3000):
        error = _sigmoid(slope * raw + shift) - goal
        slope, shift = slope - 0.05 * float((error * raw).mean()), shift - 0.05 * float(error.mean())
    net.slope, net.shift = max(slope, 1e-3), shift
    score = _sigmoid(net.slope * raw + net.shift)

    def best(part: np.ndarray) -> float:
        tried = np.linspace(0.05, 0.95, 91)
        gains = [2 * (labels[part] * (score[part] >= t)).sum() / max((labels[part] + (score[part] >= t)).sum(), 1) for t in tried]
        top = np.flatnonzero(np.isclose(gains, max(gains)))
        return float(tried[top[len(top) // 2]])

    net.thresholds = {"": best(np.ones(len(raw), dtype=bool))}
    spoken = np.array([x or "" for x in languages], dtype=object)
    for language in set(spoken) - {""}:
        part = spoken == language
        if min(labels[part].sum(), (labels[part] == 0).sum()) >= 10:
            net.thresholds[language] = best(part)


def _word_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter = Splitter(PUNCTUATION)
    for batch in batches:
        packed = []
        for _, words in splitter.batches(batch.column("text")):
            found = _buckets(words).astype(np.uint16)
            packed += [found[:, a:b].tobytes() for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        yield batch_of(
            doc_id=batch.column("doc_id"), toxic=batch.column("toxic"), lang=batch.column("lang"), words=pa.array(packed, pa.binary())
        )


def fold(column: str = "doc_id"):
    """crc32(doc_id as text) mod 3; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def fit(documents: DataFrame, labels: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> Network:
    """Trains on labelled rows outside the held-out fold; without rows of both labels the network gives low scores only."""
    usable = only(labels, ["doc_id", "toxic"]).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    usable = usable.filter(fold() != HELD_OUT).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int"))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    halves = [usable.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_documents // 2) for k in (0, 1)]
    # bounded by sample_documents, 12 bytes each
    chosen = F.broadcast(halves[0].union(halves[1]))
    language = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", language.alias("lang")).join(chosen, "doc_id")
    # rows that repeat with their id count once, and documents under one id do not add to the bound
    texts = texts.filter(F.octet_length("text") <= LONGEST_TRAINED)
    texts = texts.groupBy("doc_id", "text", "toxic").agg(F.min("lang").alias("lang"))
    texts = texts.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(sample_documents)
    packed = texts.mapInArrow(_word_buckets, "doc_id long, toxic int, lang string, words binary")
    rows, marks, languages, parts = [], [], [], []
    for r in packed.toLocalIterator():
        rows.append(np.frombuffer(r["words"], dtype=np.uint16).reshape(HASHES, -1).astype(np.int32))
        marks.append(r["toxic"])
        languages.append(r["lang"])
        parts.append(zlib.crc32(b"part" + str(r["doc_id"]).encode()) / 2**32 < CALIBRATION_SHARE)
    marks, parts = np.array(marks, dtype=np.float64), np.array(parts, dtype=bool)
    if len(set(marks[~parts])) < 2:
        return Network(
            np.zeros((HASHES, 1 << BUCKETS_LOG2, DIMENSIONS), np.float32),
            [np.zeros((w, DIMENSIONS, FILTERS), np.float32) for w in WIDTHS],
            np.zeros(len(WIDTHS) * FILTERS, np.float32),
            np.append(np.zeros(len(WIDTHS) * FILTERS), -3.0).astype(np.float32),
            thresholds={"": TOXIC_FROM},
        )
    net = train([r for r, p in zip(rows, parts, strict=True) if not p], marks[~parts])
    if len(set(marks[parts])) == 2:
        own = [r for r, p in zip(rows, parts, strict=True) if p]
        calibrate(net, raw_scores(net, own), marks[parts], [x for x, p in zip(languages, parts, strict=True) if p])
    return net


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        tables = net.tables()
        splitter = Splitter(PUNCTUATION)
        for batch in batches:
            found = np.zeros(batch.num_rows)
            for first, words in splitter.batches(batch.column("text")):
                lengths = np.diff(words.bounds)
                best, _ = net.pooled(_outputs(tables, _buckets(words)), lengths)
                found[first : first + len(lengths)] = _sigmoid(net.slope * net.logits(best) + net.shift)
            common = net.thresholds.get("", TOXIC_FROM)
            limit = np.array([net.thresholds.get(x or "", common) for x in batch.column("lang").to_pylist()])
            yield batch_of(
                doc_id=batch.column("doc_id"),
                held_out=batch.column("held_out"),
                score=pa.array(found),
                predicted=pa.array((found >= TOXIC_FROM).astype(np.int32)),
                flagged=pa.array((found >= limit).astype(np.int32)),
            )

    return run


def toxicity_scores(documents: DataFrame, net: Network) -> DataFrame:
    """``doc_id, held_out, score, predicted, flagged`` per row.

    Null and empty texts have no words and get the score of an empty text. Repeated rows are scored alike; a null id is never
    held out; without a ``lang`` column ``flagged`` uses the common threshold. Other columns are ignored.
    """
    language = F.col("lang").cast("string") if "lang" in documents.columns else F.lit(None).cast("string")
    plain = documents.select("doc_id", "text", language.alias("lang"), (fold() == HELD_OUT).alias("held_out"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    sent = documents.sparkSession.sparkContext.broadcast(net)
    schema = f"doc_id {kind}, held_out boolean, score double, predicted int, flagged int"
    return plain.mapInArrow(_score(sent), schema)
