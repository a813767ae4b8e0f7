"""Quality classifier from weak labels.

Heuristic labellers look at the whole text and vote clean, junk or abstain. Expectation-maximisation estimates how often each
labeller gives each vote for either class, from the counts of the vote patterns of all documents (at most 3**labellers rows).
The posteriors of the patterns then label a bounded sample, on which a hashed linear scorer over the shapes of words and of
neighbouring words is trained; it scores every document. Gold labels play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, only, stored
from tidegrid.llm.words import SPACE, Splitter, Words, mix

#: The scorer is fitted on about this many documents, spread over all by a hash of their shape; a bound, not a share.
SAMPLE_DOCUMENTS = 20_000
BUCKETS_LOG2 = 14
#: Documents are kept whose probability of being clean reaches this.
KEEP_FROM = 0.5
#: A labeller's junk vote on clean text is taken to be an error that is at most this common.
MOST_FALSE_ALARMS = 0.005

CLEAN, JUNK, ABSTAIN = 0, 1, 2


@dataclass(frozen=True)
class Labeller:
    """Votes on one measure: clean up to ``clean_to``, junk from ``junk_from``, else (or with few words) it abstains."""

    measure: str
    clean_to: float
    junk_from: float
    least_words: int = 1


LABELLERS = (
    Labeller("symbol_share", 0.06, 0.11, 3),
    Labeller("symbol_words", 0.05, 0.25, 3),
    Labeller("noisy_endings", 0.05, 0.3, 3),
    Labeller("upper_share", 0.2, 0.5, 3),
    Labeller("repeated_words", 0.1, 0.4, 8),
    Labeller("repeated_run", 3, 6, 8),
    Labeller("commonest_share", 0.25, 0.6, 20),
)

#: Byte classes: 0 other symbol, 1 lower-case or non-ASCII letter, 2 upper-case, 3 digit, 4 stop or comma, 5 space.
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[128:] = 1
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[44, 46, 59, 58, 63, 39, 45, 34]] = 4
_CLASS[list(SPACE)] = 5


def _sums(flags: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over [first, last)."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[last] - total[first]


def measures(words: Words, byte_bounds: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of the labellers for each text; ``byte_bounds``: where the texts begin and end in the bytes."""
    kind = _CLASS[words.data]
    first, last = byte_bounds[:-1], byte_bounds[1:]
    symbols, spaces = _sums(kind == 0, first, last), _sums(kind == 5, first, last)
    upper, lower = _sums(kind == 2, first, last), _sums(kind == 1, first, last)
    n = np.diff(words.bounds)
    from_word, to_word = words.bounds[:-1], words.bounds[1:]
    letters_in = _sums((kind >= 1) & (kind <= 3), words.start, words.end) if len(words.start) else np.zeros(0, dtype=np.int64)
    symbols_in = _sums(kind == 0, words.start, words.end) if len(words.start) else np.zeros(0, dtype=np.int64)
    same = np.zeros(len(words.hashes), dtype=bool)
    same[1:] = words.hashes[1:] == words.hashes[:-1]
    same[from_word[n > 0]] = False
    some = np.maximum(n, 1)
    runs, commonest = np.zeros(len(n)), np.zeros(len(n))
    for k in np.flatnonzero(n):
        part = same[from_word[k] : to_word[k]]
        edges = np.flatnonzero(~part)
        runs[k] = np.max(np.diff(np.append(edges, len(part))))
        found = np.sort(words.hashes[from_word[k] : to_word[k]])
        edges = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1], [True]]))
        commonest[k] = np.max(np.diff(edges)) / n[k]
    return {
        "words": n,
        "symbol_share": symbols / np.maximum(last - first - spaces, 1),
        "symbol_words": _sums(letters_in == 0, from_word, to_word) / some,
        "noisy_endings": _sums((symbols_in >= 2) & (letters_in > 0), from_word, to_word) / some,
        "upper_share": upper / np.maximum(upper + lower, 1),
        "repeated_words": _sums(same, from_word, to_word) / some,
        "repeated_run": runs,
        "commonest_share": commonest,
    }


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """One column per labeller."""
    columns = []
    for labeller in LABELLERS:
        value = found[labeller.measure]
        vote = np.where(value >= labeller.junk_from, JUNK, np.where(value <= labeller.clean_to, CLEAN, ABSTAIN))
        columns.append(np.where(found["words"] >= labeller.least_words, vote, ABSTAIN))
    return np.stack(columns, axis=1)


def pattern_of(voted: np.ndarray) -> np.ndarray:
    return voted @ (3 ** np.arange(voted.shape[1]))


def _shapes(words: Words) -> np.ndarray:
    """A hash of each word's run of byte classes (``The.`` and ``And.`` are alike); a repetition of the word before is marked."""
    kind = _CLASS[words.data].astype(np.uint64)
    turn = np.ones(len(kind), dtype=bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[words.start] = True
    turns = np.cumsum(turn)
    step = np.where(turn, mix(kind + np.uint64(7)) * (turns.astype(np.uint64) * np.uint64(2) + np.uint64(1)), np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step, dtype=np.uint64)])
    plain = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(turn, mix(kind + np.uint64(7)), np.uint64(0)), dtype=np.uint64)])
    base = (turns[words.start] if len(words.start) else np.zeros(0)).astype(np.uint64) * np.uint64(2)
    shape = mix((total[words.end] - total[words.start]) - base * (plain[words.end] - plain[words.start]))
    return shape


def features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the hashed buckets and their shares: shapes of words, of neighbours, and repeated words."""
    shape = _shapes(words)
    drop = np.uint64(64 - BUCKETS_LOG2)
    single = (mix(shape + np.uint64(1)) >> drop).astype(np.int32)
    pair = np.zeros(len(shape), dtype=np.int32)
    pair[1:] = (mix(shape[1:] * np.uint64(3) + shape[:-1]) >> drop).astype(np.int32)
    again = np.zeros(len(shape), dtype=bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    repeat = int(mix(np.array([11], dtype=np.uint64))[0] >> drop)
    for first, last in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        if first == last:
            yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            continue
        repeats = np.full(int(again[first + 1 : last].sum()), repeat, dtype=np.int32)
        bucket, count = np.unique(np.concatenate([single[first:last], pair[first + 1 : last], repeats]), return_counts=True)
        yield bucket, (count / (last - first)).astype(np.float32)


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    splitter = Splitter(SPACE)
    for batch in batches:
        for _, words in splitter.batches(batch.column("text")):
            patterns = pattern_of(votes(measures(words, words.text_bounds)))
            spread = []
            buckets, shares = [], []
            for bucket, share in features(words):
                spread.append(int(mix(np.array([bucket.sum() * 31 + len(bucket) + share.sum() * 1e6], dtype=np.float64).view(np.uint64))[0] >> np.uint64(11)))
                buckets.append(bucket.tobytes())
                shares.append(share.tobytes())
            yield batch_of(
                pattern=pa.array(patterns.astype(np.int32)),
                spread=pa.array(spread, pa.int64()),
                buckets=pa.array(buckets, pa.binary()),
                shares=pa.array(shares, pa.binary()),
            )


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: per class and labeller the chance of a junk vote, the posterior of junk per pattern, the prior.

    An abstention says nothing about the class. Labellers are specialised, so a clean vote on junk is common, but a junk vote
    on clean text is an error of at most ``MOST_FALSE_ALARMS``; this also decides which class is which.
    """
    size = len(LABELLERS)
    table = (patterns[:, None] // 3 ** np.arange(size)) % 3
    chance = np.zeros((2, size))
    chance[CLEAN], chance[JUNK] = MOST_FALSE_ALARMS, 0.3
    prior = 0.1
    weights = counts / max(counts.sum(), 1)
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        evidence = [
            np.where(table == JUNK, np.log(chance[k]), np.where(table == CLEAN, np.log1p(-chance[k]), 0.0)).sum(axis=1)
            for k in (CLEAN, JUNK)
        ]
        odds = np.log(prior) - np.log1p(-prior) + evidence[JUNK] - evidence[CLEAN]
        before, posterior = posterior, 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        for kind, share in ((JUNK, posterior * weights), (CLEAN, (1 - posterior) * weights)):
            against = ((table == JUNK) * share[:, None]).sum(axis=0)
            both = ((table != ABSTAIN) * share[:, None]).sum(axis=0)
            chance[kind] = np.clip((against + 1e-6) / (both + 1e-4), 1e-4, MOST_FALSE_ALARMS if kind == CLEAN else 0.99)
        prior = float(np.clip((posterior * weights).sum(), 1e-3, 0.5))
        if np.abs(posterior - before).max(initial=0) < 1e-9:
            break
    return chance, posterior, prior


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 400, rate: float = 0.5) -> np.ndarray:
    """Logistic regression on soft labels (chance of clean) by full-batch Adam; the last weight is the intercept."""
    size = 1 << BUCKETS_LOG2
    weights = np.zeros(size + 1)
    if not rows:
        weights[size] = 3.0
        return weights
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    value = np.concatenate([r[1] for r in rows]).astype(np.float64)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    goal = np.array([r[2] for r in rows])
    balance = np.where(goal < 0.5, 0.5 / max((goal < 0.5).mean(), 0.02), 0.5 / max((goal >= 0.5).mean(), 0.02))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, rounds + 1):
        score = np.bincount(row, value * weights[at], len(rows)) + weights[size]
        error = balance * (1 / (1 + np.exp(-np.clip(score, -30, 30))) - goal) / len(rows)
        slope = np.append(np.bincount(at, value * error[row], size), error.sum()) + 1e-6 * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return weights


@dataclass
class QualityModel:
    """Posterior of junk per vote pattern and the weights of the scorer; both of fixed size."""

    posterior: np.ndarray
    weights: np.ndarray
    chance: np.ndarray
    prior: float


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> QualityModel:
    """The model of a table with a ``text`` column. Pattern counts cover all rows, the scorer's sample is bounded."""
    schema = "pattern int, spread long, buckets binary, shares binary"
    seen = stored(only(documents, ["text"]).mapInArrow(_voted, schema), "votes")
    counted = seen.groupBy("pattern").count().collect()
    patterns = np.array([r["pattern"] for r in counted], dtype=np.int64)
    chance, found, prior = fit_labellers(patterns, np.array([r["count"] for r in counted], dtype=np.float64))
    posterior = np.full(3 ** len(LABELLERS), 0.0)
    posterior[patterns] = found
    total = sum(r["count"] for r in counted)
    share = min(1.0, sample_documents / max(total, 1))
    near = seen.filter(F.col("spread") < int(share * 2**53) + 1).dropDuplicates(["spread"])  # copies count once
    sample = near.orderBy("spread").limit(2 * sample_documents).select("pattern", "buckets", "shares")
    rows = [
        (np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["shares"], np.float32), 1 - posterior[r["pattern"]])
        for r in sample.toLocalIterator()
    ]
    return QualityModel(posterior, fit_scorer(rows), chance, prior)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(SPACE)
        weights, posterior = model.value.weights, model.value.posterior
        for batch in batches:
            chance, score = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            pattern = np.zeros(batch.num_rows, dtype=np.int32)
            for first, words in splitter.batches(batch.column("text")):
                part = pattern_of(votes(measures(words, words.text_bounds)))
                pattern[first : first + len(words)] = part
                chance[first : first + len(words)] = posterior[part]
                for k, (bucket, share) in enumerate(features(words), first):
                    value = float(weights[bucket] @ share + weights[-1]) if len(bucket) else 0.0
                    score[k] = 1 / (1 + np.exp(-min(max(value, -30), 30)))
            columns = {name: batch.column(name) for name in batch.schema.names}
            yield batch_of(
                **columns, pattern=pa.array(pattern), junk_posterior=pa.array(chance), clean_score=pa.array(score)
            )

    return run


def score(documents: DataFrame, model: QualityModel, columns: list[str] | None = None) -> DataFrame:
    """The named columns (all by default; ``text`` among them) with ``pattern``, ``junk_posterior``, ``clean_score``.

    Null, empty and blank texts have no evidence against them: posterior of their pattern, score 0.5. Added columns replace
    input columns of the same name.
    """
    added = {"pattern", "junk_posterior", "clean_score"}
    kept = only(documents, [c for c in (columns or documents.columns) if c not in added])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(_scored(sent), schema + ", pattern int, junk_posterior double, clean_score double")


def kept_documents(documents: DataFrame) -> DataFrame:
    """The rows of the table that the classifier keeps, with the columns of the table, whatever their names.

    Null, empty and blank texts are kept, repeated rows are judged alike; a very long text counts whole.
    """
    # on their way through the scorer the columns have names that its own cannot clash with
    names = [c if c == "text" else f"column {k}" for k, c in enumerate(documents.columns)]
    scored = score(documents.toDF(*names), fit(documents))
    return scored.filter(F.col("clean_score") >= KEEP_FROM).select(*[f"`{c}`" for c in names]).toDF(*documents.columns)


def quality_scores(documents: DataFrame) -> DataFrame:
    """``doc_id, pattern, junk_posterior, clean_score, kept`` of every document."""
    scored = score(only(documents, ["doc_id", "text"]), fit(documents))
    return scored.select("doc_id", "pattern", "junk_posterior", "clean_score", (F.col("clean_score") >= KEEP_FROM).alias("kept"))
