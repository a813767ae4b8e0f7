"""Personal data: base patterns, and a semi-Markov conditional random field over whole candidate spans.

Texts are cut into clusters of atoms around digits and ``@``. A segmentation of a cluster gives every segment a type or none; its
score is a sum over whole segments of weights of features of the whole span (digit counts, separators, check digits, neighbours).
Segments have at most ``MOST_ATOMS`` atoms, so a dynamic programme over ends and starts finds the best segmentation, and the same
recursion in logarithms gives the likelihood and its gradient for training. One programme runs over a whole cluster, whatever its
length, and holds the scores of the last ``MOST_ATOMS`` places only. Training data are clusters of a bounded sample of documents,
labelled by the base patterns; the field adds spans that look like them but escape the patterns. Base spans stay.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, hash_share, only, stored

KINDS = ("email", "ip", "card", "phone")
MOST_ATOMS = 16

# The base patterns. Runs of digits are entered at their start only, which changes no match and avoids retries.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

#: Clusters are white-space separated pieces with a digit or @, joined over single spaces; atoms are what they are made of.
PIECE = re.compile(r"\S+")
TELLING = re.compile(r"[0-9@]")
ATOM = re.compile(r"[0-9]+|[^\W\d_]+|\s+|[\W_]", re.UNICODE)

#: Documents of the training sample (about so many, spread by a hash), distinct clusters of the training set, the longest of them
#: in characters (all are decoded), and the least margin of an added span.
SAMPLE_DOCUMENTS = 50_000
SAMPLE_CLUSTERS = 3_000
LONGEST_TRAINED = 200
LEAST_MARGIN = 4.0
FEATURES_LOG2 = 12

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        value = int(c) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    """Each @ in turn: the local part is what stands before it and is not used yet, the domain what follows."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield "email", start, m.end()
            used = m.end()
        at = text.find("@", max(at + 1, used))


def base_spans(text: str) -> list[Span]:
    """Base matches, leftmost and not overlapping per kind; by kind, then start."""
    found: list[Span] = list(_emails(text))
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


def clusters(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the clusters of a whole text, in one pass; a + one space before a cluster belongs to it."""
    start, end, before = None, 0, 0
    for m in PIECE.finditer(text):
        near = before > 0 and text[before : m.start()] == " "
        if not TELLING.search(text, m.start(), m.end()):
            if start is not None:
                yield start, end
                start = None
        elif start is not None and near:
            end = m.end()
        else:
            if start is not None:
                yield start, end
            # a + that ends the piece before
            start, end = (before - 1 if near and text[before - 1] == "+" else m.start()), m.end()
        before = m.end()
    if start is not None:
        yield start, end


def _beside(text: str, at: int) -> str:
    """The character beside a span; the end of the text is like white space."""
    c = text[at] if 0 <= at < len(text) else " "
    return "a" if c.isalnum() else "" if c.isspace() else c


def _features(kind: str, text: str, start: int, end: int, atoms: int) -> list[int]:
    """Hashed features of a whole span under a type (empty: none of them)."""
    word = text[start:end]
    digits = _digits(word)
    n = len(digits)
    letters = sum(c.isalpha() for c in word)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", word))
    parts = word.split(".")
    names = [
        "bias",
        f"digits={min(n, 20)}",
        f"letters={min(letters, 3)}",
        f"atoms={atoms}",
        f"shape={shape}" if len(shape) <= 24 else "shape=long",
        f"first={shape[0]}",
        f"last={shape[-1]}",
        f"before={_beside(text, start - 1)}",
        f"after={_beside(text, end)}",
        f"at={word.count('@')},{'.' in word.rpartition('@')[2]}",
        f"octets={len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)}",
        f"luhn={n >= 13 and not letters and luhn(digits)},{n >= 16}",
        f"only={''.join(sorted(set(c for c in word if not c.isalnum())))[:6]},{n > 7}",
    ]
    mask = (1 << FEATURES_LOG2) - 1
    return [int.from_bytes(hashlib.blake2b(f"{kind}|{name}".encode(), digest_size=4).digest(), "little") & mask for name in names]


def _segments_from(text: str, bounds: list[int], i: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """(end, kind) of the segments that begin with atom ``i`` and may be entities, and their features."""
    first = text[bounds[i]]
    segments, features = [], []
    if first.isalnum() or first in "+(":
        for j in range(i + 1, min(len(bounds) - 1, i + MOST_ATOMS) + 1):
            begin, stop = bounds[i], bounds[j]
            if text[stop - 1].isalnum() and any(c.isdigit() or c == "@" for c in text[begin:stop]):
                for k, kind in enumerate(KINDS):
                    segments.append((j, k))
                    features.append(_features(kind, text, begin, stop, j - i))
    return segments, features


class Cluster:
    """Atoms of one cluster and the segments that may be entities: they begin and end with a letter, a digit, + or (."""

    def __init__(self, text: str, start: int, end: int):
        self.bounds = [start] + [m.end() for m in ATOM.finditer(text, start, end)]
        self.size = len(self.bounds) - 1
        self.segments: list[tuple[int, int, int]] = []
        self.features: list[list[int]] = []
        for i in range(self.size):
            segments, features = _segments_from(text, self.bounds, i)
            self.segments += [(i, j, k) for j, k in segments]
            self.features += features

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return weights[np.array(self.features)].sum(axis=1) if self.features else np.zeros(0)

    def best(self, weights: np.ndarray) -> list[tuple[int, int, int, float]]:
        """The best segmentation, as entity segments with their scores (atoms outside score 0)."""
        scores = self.scores(weights)
        into: list[list[int]] = [[] for _ in range(self.size + 1)]
        for s, (_, j, _) in enumerate(self.segments):
            into[j].append(s)
        value, back = [0.0] * (self.size + 1), [-1] * (self.size + 1)
        for j in range(1, self.size + 1):
            value[j] = value[j - 1]
            for s in into[j]:
                if (v := value[self.segments[s][0]] + scores[s]) > value[j]:
                    value[j], back[j] = v, s
        chosen, j = [], self.size
        while j > 0:
            if back[j] < 0:
                j -= 1
                continue
            i, _, k = self.segments[back[j]]
            chosen.append((i, j, k, float(scores[back[j]])))
            j = i
        return chosen[::-1]

    def expectations(self, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """Chance of every segment under the field and the log of its partition sum (forward and backward recursion)."""
        scores = self.scores(weights)
        into: list[list[int]] = [[] for _ in range(self.size + 1)]
        out: list[list[int]] = [[] for _ in range(self.size + 1)]
        for s, (i, j, _) in enumerate(self.segments):
            into[j].append(s)
            out[i].append(s)
        forward, backward = np.zeros(self.size + 1), np.zeros(self.size + 1)
        for j in range(1, self.size + 1):
            terms = [forward[j - 1], *[forward[self.segments[s][0]] + scores[s] for s in into[j]]]
            top = max(terms)
            forward[j] = top + math.log(sum(math.exp(t - top) for t in terms))
        for i in range(self.size - 1, -1, -1):
            terms = [backward[i + 1], *[backward[self.segments[s][1]] + scores[s] for s in out[i]]]
            top = max(terms)
            backward[i] = top + math.log(sum(math.exp(t - top) for t in terms))
        total = forward[self.size]
        chance = [math.exp(min(0.0, forward[i] + scores[s] + backward[j] - total)) for s, (i, j, _) in enumerate(self.segments)]
        return np.array(chance), float(total)

    def gold(self, spans: list[Span]) -> list[int]:
        """The segments that are base spans; of overlapping ones the first by start, then the longest."""
        wanted = {(s, e, KINDS.index(k)) for k, s, e in spans}
        found = [s for s, (i, j, k) in enumerate(self.segments) if (self.bounds[i], self.bounds[j], k) in wanted]
        chosen, used = [], 0
        for s in sorted(found, key=lambda s: (self.segments[s][0], -self.segments[s][1])):
            if self.segments[s][0] >= used:
                chosen.append(s)
                used = self.segments[s][1]
        return chosen


def train(clusters: list[tuple[Cluster, list[int]]], rounds: int = 6, rate: float = 0.3, keep: float = 1e-4) -> np.ndarray:
    """Adagrad on the conditional log likelihood."""
    weights = np.zeros(1 << FEATURES_LOG2)
    square = np.full(len(weights), 1.0)
    order = np.random.default_rng(3)
    for _ in range(rounds):
        for k in order.permutation(len(clusters)):
            cluster, gold = clusters[k]
            if not cluster.features:
                continue
            push, _ = cluster.expectations(weights)
            push = -push
            push[gold] += 1
            busy = np.flatnonzero(np.abs(push) > 1e-4)
            if len(busy):
                slope = np.zeros(len(weights))
                table = np.array(cluster.features)[busy]
                np.add.at(slope, table.ravel(), np.repeat(push[busy], table.shape[1]))
                touched = np.unique(table)
                slope[touched] -= keep * weights[touched]
                square[touched] += slope[touched] ** 2
                weights[touched] += rate * slope[touched] / np.sqrt(square[touched])
    return weights


def best_spans(text: str, start: int, end: int, weights: np.ndarray) -> Iterator[tuple[str, int, int, float]]:
    """The best segmentation of one cluster, as ``Cluster.best`` finds it, with the segments of one place at a time in memory."""
    bounds = [start] + [m.end() for m in ATOM.finditer(text, start, end)]
    size = len(bounds) - 1
    value, back = [0.0] * (size + 1), [None] * (size + 1)
    waiting: dict[int, tuple[float, int, int, float]] = {}  # end -> value, start, kind, score of the best segment so far
    for i in range(size):
        if i:
            value[i] = value[i - 1]
            best = waiting.pop(i, None)
            if best and best[0] > value[i]:
                value[i], back[i] = best[0], best[1:]
        segments, features = _segments_from(text, bounds, i)
        if segments:
            for (j, k), score in zip(segments, weights[np.array(features)].sum(axis=1).tolist(), strict=True):
                if j not in waiting or value[i] + score > waiting[j][0]:
                    waiting[j] = (value[i] + score, i, k, score)
    if size:
        value[size] = value[size - 1]
        best = waiting.pop(size, None)
        if best and best[0] > value[size]:
            back[size] = best[1:]
    chosen, j = [], size
    while j > 0:
        if back[j] is None:
            j -= 1
            continue
        i, k, score = back[j]
        chosen.append((KINDS[k], bounds[i], bounds[j], score))
        j = i
    return reversed(chosen)


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """What the field takes for personal data beside the base spans, which win where they touch; one pass over both."""
    if not any("0" <= c <= "9" for c in text) and "@" not in text:
        return []
    covered = _merged(base)
    found: list[Span] = []
    first = 0
    for opening, closing in clusters(text):
        while first < len(covered) and covered[first][1] <= opening:
            first += 1
        last = first
        while last < len(covered) and covered[last][0] < closing:
            last += 1
        own = covered[first:last]
        # a cluster that is a base span and nothing else has nothing to add
        if not any(c.isdigit() or c == "@" for c in _outside(text, opening, closing, own)):
            continue
        place = 0
        for kind, start, end, score in best_spans(text, opening, closing, weights):
            while place < len(own) and own[place][1] <= start:
                place += 1
            if score >= LEAST_MARGIN and (place == len(own) or own[place][0] >= end):
                found.append((kind, start, end))
    return found


def _merged(spans: list[Span]) -> list[tuple[int, int]]:
    """The places that the spans cover, as sorted ranges that do not overlap."""
    out: list[tuple[int, int]] = []
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _outside(text: str, start: int, end: int, covered: list[tuple[int, int]]) -> str:
    pieces, at = [], start
    for s, e in covered:
        if e > at and s < end:
            pieces.append(text[at : max(at, s)])
            at = e
    return "".join([*pieces, text[at:end]])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clusters of the sampled documents, with a little text around, and the base spans in them."""
    for batch in batches:
        texts, spans, hits = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            order = sorted(base, key=lambda s: s[1])
            starts = [s[1] for s in order]
            for start, end in clusters(text):
                if end - start <= LONGEST_TRAINED:
                    own = order[bisect_left(starts, start) : bisect_left(starts, end)]
                    inside = sorted(((k, s - start, e - start) for k, s, e in own if e <= end), key=lambda s: (KINDS.index(s[0]), s[1]))
                    texts.append(text[start:end])
                    spans.append(joined(inside))
                    hits.append(inside[0][0] if inside else "")
        yield batch_of(text=pa.array(texts, pa.string()), spans=pa.array(spans, pa.string()), kind=pa.array(hits, pa.string()))


def parse(spans: str) -> list[Span]:
    return [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in spans.split(","))] if spans else []


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_clusters: int = SAMPLE_CLUSTERS) -> np.ndarray:
    """Weights, from at most ``sample_clusters`` distinct clusters of a bounded sample of documents, evenly over the kinds."""
    share = sample_documents / max(documents.count(), 1)
    sample = only(documents, ["text"]).filter(hash_share(share, "text"))
    seen = sample.mapInArrow(_clusters, "text string, spans string, kind string").distinct()
    seen = stored(seen.withColumn("at", F.xxhash64("text")), "clusters")
    clusters = []
    for kind in (*KINDS, ""):
        chosen = seen.filter(F.col("kind") == kind).orderBy("at", "text").limit(sample_clusters // 5)
        for r in chosen.collect():
            cluster = Cluster(r["text"], 0, len(r["text"]))
            clusters.append((cluster, cluster.gold(parse(r["spans"]))))
    return train(clusters)


def _found(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, spans, extra = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                more = added_spans(text, base, weights)
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in base))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))))
                extra.append(len(more))
            yield batch_of(
                doc_id=batch.column("doc_id"),
                **{f"n_{kind}": pa.array(counts[kind], pa.int64()) for kind in KINDS},
                base_sha256=pa.array(digests, pa.string()),
                spans=pa.array(spans, pa.string()),
                n_added=pa.array(extra, pa.int64()),
            )

    return run


def personal_data(documents: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added`` per row; counts and digest are of base spans.

    A null text counts as empty: no spans, the digest of nothing. A text of any length is read whole, in time in proportion to it.
    Repeated rows have equal results; other columns are ignored.
    """
    plain = only(documents, ["doc_id", "text"])
    sent = documents.sparkSession.sparkContext.broadcast(fit(plain) if weights is None else weights)
    kind = plain.schema["doc_id"].dataType.simpleString()
    counted = ", ".join(f"n_{k} long" for k in KINDS)
    return plain.mapInArrow(_found(sent), f"doc_id {kind}, {counted}, base_sha256 string, spans string, n_added long")
