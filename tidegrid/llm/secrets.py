"""Secret scan: base patterns, and automata inferred from the credentials they label.

The base patterns find credentials by their surroundings or alphabet. Their strings, from a bounded sample of documents, are
put into a prefix tree per kind; states whose outgoing frequencies are statistically compatible (Hoeffding) are merged, which
leaves a small probabilistic automaton of the format. Every other candidate of every whole text is then scored by its likelihood
under the automata against that of ordinary words; what looks like a labelled credential becomes an extra span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import batch_of, hash_share, only, stored

# The base patterns and the least sizes of what they find.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "inferred")
LEAST_VALUE, LEAST_ACCESS = 12, 18
_HINTS = ("password", "passwd", "secret", "token", "api")

#: A candidate is a run of credential characters with a digit or with capitals inside.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_LONG_WORD = re.compile(r"[A-Za-z]{12,}")

#: Documents that the automata are fitted on (about so many, spread by a hash), distinct strings per kind, and the fewest strings
#: of a kind from which a format is inferred: with fewer the threshold would rest on less than a handful of them.
SAMPLE_DOCUMENTS = 50_000
SAMPLE_STRINGS = 2_000
LEAST_STRINGS = 20
#: Confidence of the compatibility test, and the share of labelled credentials that may score below the threshold.
ALPHA = 0.05
MISSED_SHARE = 0.02

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Base matches, leftmost and not overlapping per kind; by start, then kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(hint in lowered for hint in _HINTS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def labelled_strings(text: str) -> Iterator[tuple[str, str]]:
    """(kind, credential) of the base matches; for assignments the value."""
    for kind, start, end in base_spans(text):
        yield kind, ASSIGN.fullmatch(text, start, end)[2] if kind == "assign" else text[start:end]


def _symbol(c: str) -> str:
    """Characters of one class are interchangeable in a format: digits, a-f, g-z, A-F, G-Z; others stand for themselves."""
    if "0" <= c <= "9":
        return "0"
    if "a" <= c <= "z":
        return "a" if c <= "f" else "g"
    if "A" <= c <= "Z":
        return "A" if c <= "F" else "G"
    return c


_CLASS_SIZE = {"0": 10, "a": 6, "g": 20, "A": 6, "G": 20}
_FLOOR = math.log(1e-4)


@dataclass
class Automaton:
    """A probabilistic automaton: per state the end probability and, per symbol, probability and next state."""

    ends: list[float]
    moves: list[dict[str, tuple[float, int]]]

    def mean_log(self, word: str) -> float:
        """Log likelihood per character, the end included."""
        state, total = 0, 0.0
        for c in word:
            s = _symbol(c)
            move = self.moves[state].get(s) if state >= 0 else None
            if move is None:
                total, state = total + _FLOOR, state if state >= 0 else 0
            else:
                total, state = total + move[0] - math.log(_CLASS_SIZE.get(s, 1)), move[1]
        return (total + self.ends[state]) / (len(word) + 1)


@dataclass
class _Tree:
    """A prefix tree with counts; merged states keep one representative."""

    arrive: list[int] = field(default_factory=lambda: [0])
    end: list[int] = field(default_factory=lambda: [0])
    go: list[dict[str, int]] = field(default_factory=lambda: [{}])
    taken: list[dict[str, int]] = field(default_factory=lambda: [{}])

    def add(self, word: str) -> None:
        state = 0
        for c in word:
            s = _symbol(c)
            self.arrive[state] += 1
            self.taken[state][s] = self.taken[state].get(s, 0) + 1
            if s not in self.go[state]:
                self.go[state][s] = len(self.go)
                self.arrive.append(0)
                self.end.append(0)
                self.go.append({})
                self.taken.append({})
            state = self.go[state][s]
        self.arrive[state] += 1
        self.end[state] += 1


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    bound = math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) > bound


def _compatible(tree: _Tree, a: int, b: int, alpha: float) -> bool:
    """Do both states and all they lead to have like frequencies?"""
    open_pairs = [(a, b)]
    while open_pairs:
        a, b = open_pairs.pop()
        if _differ(tree.end[a], tree.arrive[a], tree.end[b], tree.arrive[b], alpha):
            return False
        for s in tree.go[a].keys() | tree.go[b].keys():
            if _differ(tree.taken[a].get(s, 0), tree.arrive[a], tree.taken[b].get(s, 0), tree.arrive[b], alpha):
                return False
            if s in tree.go[a] and s in tree.go[b] and tree.go[a][s] != tree.go[b][s]:
                open_pairs.append((tree.go[a][s], tree.go[b][s]))
    return True


def _fold(tree: _Tree, red: int, blue: int) -> None:
    """Adds the counts of the subtree of ``blue`` to ``red`` and what it leads to."""
    open_pairs = [(red, blue)]
    while open_pairs:
        a, b = open_pairs.pop()
        tree.arrive[a] += tree.arrive[b]
        tree.end[a] += tree.end[b]
        for s, target in tree.go[b].items():
            tree.taken[a][s] = tree.taken[a].get(s, 0) + tree.taken[b][s]
            if s in tree.go[a]:
                open_pairs.append((tree.go[a][s], target))
            else:
                tree.go[a][s] = target


def infer(words: Iterable[str], alpha: float = ALPHA) -> Automaton:
    """State merging over the prefix tree, from the root outwards: settled states, and states one step beyond them."""
    tree = _Tree()
    for word in words:
        tree.add(word)
    settled, members = [0], {0}
    while True:
        fringe = sorted(
            ((r, s, t) for r in settled for s, t in tree.go[r].items() if t not in members),
            key=lambda x: (-tree.arrive[x[2]], x[2]),
        )
        if not fringe:
            break
        source, symbol, state = fringe[0]
        for red in settled:
            if _compatible(tree, red, state, alpha):
                tree.go[source][symbol] = red
                _fold(tree, red, state)
                break
        else:
            settled.append(state)
            members.add(state)
    number = {state: k for k, state in enumerate(settled)}
    ends, moves = [], []
    for state in settled:
        n = tree.arrive[state] + 1e-3 * 2
        ends.append(math.log((tree.end[state] + 1e-3) / n))
        moves.append({s: (math.log(tree.taken[state][s] / n), number[t]) for s, t in tree.go[state].items()})
    return Automaton(ends, moves)


@dataclass
class SecretModel:
    """Automata per kind, each with the least score of a credential of that kind, and the model of ordinary words."""

    automata: dict[str, tuple[Automaton, float]]
    ordinary: Automaton

    def is_secret(self, word: str) -> bool:
        usual = self.ordinary.mean_log(word)
        return any(score >= least and score > usual for a, least in self.automata.values() for score in [a.mean_log(word)])


def fit_strings(strings: dict[str, list[str]], words: list[str]) -> SecretModel:
    """Automata from labelled credentials; every fifth string is kept from the tree and used for the threshold.

    A kind with fewer than LEAST_STRINGS distinct strings gets no automaton.
    """
    automata = {}
    for kind in KINDS[:3]:
        own = sorted(set(strings.get(kind, [])), key=lambda w: hashlib.md5(w.encode()).digest())
        if len(own) < LEAST_STRINGS:
            continue
        built = infer(w for k, w in enumerate(own) if k % 5)
        held = sorted(built.mean_log(w) for k, w in enumerate(own) if k % 5 == 0)
        automata[kind] = (built, held[int(len(held) * MISSED_SHARE)])
    counts = Counter(s for w in words for s in map(_symbol, w))
    total = sum(counts.values()) + len(words) + 1
    moves = {s: (math.log(c / total), 0) for s, c in counts.items()}
    return SecretModel(automata, Automaton([math.log((len(words) + 1) / total)], [moves]))


def _ordinary_candidate(word: str) -> bool:
    return word.isalpha() and (word.islower() or word[1:].islower() or word.isupper())


def inferred_spans(text: str, base: list[Span], model: SecretModel) -> list[Span]:
    """Candidates that an automaton takes for credentials, unless a base span holds them whole; one pass over both lists."""
    found = []
    place, reached = 0, 0
    for m in CANDIDATE.finditer(text):
        while place < len(base) and base[place][1] <= m.start():
            reached = max(reached, base[place][2])
            place += 1
        word = m[0]
        if reached < m.end() and not _ordinary_candidate(word) and model.is_secret(word):
            found.append(("inferred", m.start(), m.end()))
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct labelled strings and ordinary words of the whole sampled texts, batch by batch."""
    for batch in batches:
        seen: set[tuple[str, str]] = set()
        for value in batch.column("text"):
            text = value.as_py() or ""
            seen.update(labelled_strings(text))
            seen.update(("ordinary", w) for w in _LONG_WORD.findall(text) if _ordinary_candidate(w))
        yield batch_of(kind=pa.array([k for k, _ in seen], pa.string()), word=pa.array([w for _, w in seen], pa.string()))


def fit(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS) -> SecretModel:
    """The model of a table: labelled strings and ordinary words of a bounded sample of its documents, each taken whole.

    Of each kind at most SAMPLE_STRINGS distinct strings are used, those with the least hashes.
    """
    share = sample_documents / max(documents.count(), 1)
    words = only(documents, ["text"]).filter(hash_share(share, "text")).mapInArrow(_sampled, "kind string, word string").distinct()
    strings: dict[str, list[str]] = {}
    order = stored(words.select("kind", "word", F.xxhash64("word").alias("at")), "strings")
    for kind in (*KINDS[:3], "ordinary"):
        chosen = order.filter(F.col("kind") == kind).orderBy("at", "word").limit(SAMPLE_STRINGS)
        strings[kind] = [r["word"] for r in chosen.collect()]
    return fit_strings(strings, strings.pop("ordinary"))


def _scanned(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            counts: dict[str, list[int]] = {kind: [] for kind in KINDS}
            digests, spans = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                every = sorted(base + inferred_spans(text, base, model), key=lambda s: (s[1], KINDS.index(s[0])))
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in every))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            columns = {name: batch.column(name) for name in batch.schema.names}
            added = {f"n_{kind}": pa.array(counts[kind], pa.int64()) for kind in KINDS}
            yield batch_of(**columns, **added, base_sha256=pa.array(digests, pa.string()), spans=pa.array(spans, pa.string()))

    return run


_ADDED = "n_assign long, n_access long, n_hex long, n_inferred long, base_sha256 string, spans string"


def scan(documents: DataFrame, model: SecretModel) -> DataFrame:
    """The columns of the table and ``n_assign, n_access, n_hex, n_inferred, base_sha256, spans``.

    A null text counts as empty: no spans, the digest of nothing. A text of any length is scanned whole, in time in proportion to
    it. Repeated rows have equal results; added columns replace columns of the same name.
    """
    names = {part.split()[0] for part in _ADDED.split(", ")}
    kept = only(documents, [c for c in documents.columns if c not in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    sent = documents.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(_scanned(sent), f"{schema}, {_ADDED}")


def secret_scan(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the digest columns of every document."""
    plain = only(documents, ["doc_id", "text"])
    found = scan(plain, fit(plain))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_inferred")


def mask(text: str, spans: list[Span], mark: str = "<SECRET>") -> str:
    """The text with a mark for each run of touching or overlapping spans."""
    pieces, at = [], -1
    for _, start, end in sorted(spans, key=lambda s: s[1]):
        if start > at:
            pieces += [text[max(at, 0) : start], mark]
        at = max(at, end)
    return "".join([*pieces, text[max(at, 0) :]])


def _masked(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                texts.append(text and mask(text, base + inferred_spans(text, base, sent.value)))
            columns = {name: batch.column(name) for name in batch.schema.names}
            yield batch_of(**(columns | {"text": pa.array(texts, pa.string())}))

    return run


def mask_secrets(documents: DataFrame) -> DataFrame:
    """The table with every found span replaced by a mark; a null text stays null; columns and rows are those of the input."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    return documents.mapInArrow(_masked(sent), schema)
