"""URL rules, clusters by bit planes and the prefix trie, against plain versions and their SQL twins."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from compare import connect
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegrid.llm import centroids, conversation_trie, url_rules
from tidegrid.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
NEW = [name for name in QUERIES if name.startswith(("op11_", "op12_", "op13_"))]


def shown(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql_twins(spark, name):
    found = QUERIES[name](spark, FOLDER)
    sql = connect(FOLDER).sql(ORACLE_SQL[name])
    assert sql.columns == found.columns
    assert shown(found.collect()) == shown(sql.fetchall())


# URL rules -----------------------------------------------------------------------------------------------------------


def plain_url(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return host.translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), path


def plain_verdict(url, host_rules, patterns):
    host, path = plain_url(url)
    fits = []
    for action, rule in host_rules:
        name, slash, start = rule.partition("/")
        start = slash + start
        if (host == name or host.endswith("." + name)) and path.startswith(start):
            fits.append((len(rule), rule, action))
    if fits:
        return host, path, max(fits)[1], max(fits)[2], None
    small = (url or "").translate(str.maketrans(url_rules.UPPER, url_rules.LOWER))
    hits = defaultdict(list)
    for action, pattern in patterns:
        if plain_pattern(pattern, small):
            hits[action].append(pattern)
    for action in ("allow", "block"):
        if hits[action]:
            return host, path, None, action, min(hits[action])
    return host, path, None, "allow", None


def plain_pattern(pattern, url):
    """Tries every place at which the pattern may start, one character at a time."""
    ends = pattern.endswith("|")
    body = pattern[:-1] if ends else pattern
    starts = range(len(url) + 1)
    if body.startswith("||"):
        body, m = body[2:], re.match(r"[^:/?#]+://", url)
        host = re.match(r"[^/?#]*", url[m.end() :])[0] if m else ""
        starts = [m.end() + k for k in range(len(host) + 1) if k == 0 or host[k - 1] == "."] if m else []
    elif body.startswith("|"):
        body, starts = body[1:], [0]

    def fits(p, u):
        if p == len(body):
            return not ends or u == len(url)
        if body[p] == "*":
            return any(fits(p + 1, k) for k in range(u, len(url) + 1))
        if body[p] == "^":
            return (u < len(url) and not re.match(r"[0-9a-z_.%-]", url[u]) and fits(p + 1, u + 1)) or (u == len(url) and fits(p + 1, u))
        return u < len(url) and url[u] == body[p] and fits(p + 1, u + 1)

    return any(fits(0, s) for s in starts)


URLS = [
    None, "", "no scheme", "://", "http://", "http://NET/", "http://net", "http://a.Net/x", "http://anet/", "http://example.net/en/a",
    "http://example.net/EN/a", "https://www.example.com/de/1?u=1#x", "https://example.com/de", "https://x.org/fr/", "https://x.org/fr",
    "http://adult-x.example.org/en", "http://my-adult-x.example.org/", "http://x.cheap-pills.org/robots.txt", "http://q.org/wp-login.php",
    "http://q.org/wp-login.phpx", "a://b://net/", "http://u@net/", "http://net?x", "http://net#x", "http://x.org/a\nb/robots.txt", "x" * 100_000,
    "http://" + "a." * 30_000 + "net/", "HTTP://CASINO-1.org/", "http://x.org/http://spam-farm.org", "http://ääß.net/é", "ftp://free-bets.x/",
]


def test_urls_and_verdicts(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[7], "x"), (3, URLS[9], "y"), (3, URLS[9], "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = url_rules.judged_urls(pages).collect()
    wanted = [(k, *plain_verdict(u, url_rules.HOST_RULES, url_rules.PATTERNS)) for k, u, _ in rows]
    assert shown(found) == shown(wanted)
    assert url_rules.judged_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_random_rules_are_found_through_their_tokens(spark, seed):
    rng = random.Random(seed)
    words = ["a", "b", "ab", "ba", "x-a", "net", "org", "a1"]

    def path():
        return "/" + "/".join(rng.choices([*words, ""], k=rng.randint(0, 3)))

    urls = [f"{rng.choice(['http', 'ws'])}://" + ".".join(rng.choices(words, k=rng.randint(1, 3))) + path() for _ in range(150)]
    urls = [rng.choice(["", "#t", "?q=ab"]).join([u, ""]) if rng.random() < 0.5 else u.upper() for u in urls]
    host_rules = {(".".join(rng.choices(words, k=rng.randint(1, 2))) + path()): rng.choice(["block", "allow"]) for _ in range(12)}
    host_rules = [(action, rule) for rule, action in host_rules.items()]
    patterns = set()
    while len(patterns) < 25:
        body = "".join(rng.choices([*words, "*", "^", "/", ".", "-"], k=rng.randint(1, 4)))
        patterns.add((rng.choice(["block", "allow"]), rng.choice(["", "|", "||"]) + body + rng.choice(["", "|"])))
    rules = url_rules.rules_table(spark, host_rules, patterns)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    wanted = [(k, *plain_verdict(u, host_rules, patterns)) for k, u in enumerate(urls)]
    assert shown(url_rules.judged_urls(pages, rules).collect()) == shown(wanted)


def test_rules_stand_under_their_rarest_token(spark):
    urls = spark.createDataFrame([("http://www.a.net/x",), ("http://www.b.net/y",), ("http://c.net/y",)], "lowered string")
    urls = urls.withColumn("tokens", url_rules.url_tokens(urls["lowered"]))
    rules = url_rules.rules_table(spark, [("block", "www.net/y"), ("block", "net/x")], [("block", "*w*"), ("block", "||www.a.")])
    found = {r["rule"]: r["token"] for r in url_rules.token_index(urls, rules).collect()}
    # a path that may go on has no whole last token; the letters between stars have none at all
    assert found == {"www.net/y": "www", "net/x": "net", "*w*": "", "||www.a.": "a"}


def test_rules_without_a_host_or_action_are_errors():
    with pytest.raises(ValueError):
        url_rules.host_rule("block", "/x")
    with pytest.raises(ValueError):
        url_rules.pattern_rule("drop", "x")


# Bit planes ----------------------------------------------------------------------------------------------------------


def plain_clusters(rows, many=16, rounds=3):
    kept = []
    for vec_id, x in rows:
        if x is not None and len(x) == 64 and all(v is not None and math.isfinite(v) for v in x):
            tops = [v.as_integer_ratio() for v in x]
            kept.append((vec_id, [64 * a // b for a, b in tops]))
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()))
    middle = [v for _, v in order[:many]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(middle))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        middle = [[sum(p) // len(own[k]) for p in zip(*own[k], strict=True)] if k in own else c for k, c in enumerate(middle)]
    found = [(vec_id, *nearest(v)[::-1]) for vec_id, v in kept]
    fit = lambda n: n if n < 1 << 63 else None
    sums = defaultdict(int)
    for _, c, d in found:
        sums[c] += d
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return [(i, c, fit(d), fit(sums[c]), fit(sum(sums.values())), names[c]) for i, c, d in found]


def vectors_of(spark, rows, partitions=5):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions)


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(k % 7, 1.5) for _ in range(64)]) for k in range(300)]
    rows += [(1000 + k, rows[5][1]) for k in range(150)]  # a third alike
    rows += [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [math.inf] * 64), (2005, [])]
    rows += [(None, [0.5] * 64), (7, rows[7][1]), (7, rows[7][1]), (2006, [0.0] * 64), (2007, [-1 / 64] * 64)]
    assert shown(centroids.centroid_clusters(vectors_of(spark, rows)).collect()) == shown(plain_clusters(rows))


def test_clusters_of_huge_components_are_exact(spark):
    rng = random.Random(2)
    sizes = [1.0, 2.0**20, 2.0**40, 1e30, 1e300]
    rows = [(k, [rng.uniform(-1, 1) * sizes[k % 5] for _ in range(64)]) for k in range(40)]
    found = centroids.centroid_clusters(vectors_of(spark, rows)).collect()
    assert shown(found) == shown(plain_clusters(rows)) and any(r["distance"] is None for r in found)


@pytest.mark.parametrize("many", [0, 1, 3])
def test_few_vectors(spark, many):
    rows = [(k, [float(k)] * 64) for k in range(many)]
    assert shown(centroids.centroid_clusters(vectors_of(spark, rows, 3)).collect()) == shown(plain_clusters(rows))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**33), 2**33), min_size=64, max_size=64), min_size=1, max_size=4), st.integers(0, 3))
def test_planes_give_exact_products(rows, extra):
    planes = max(map(centroids.planes_needed, rows)) + extra  # a longer sign changes nothing
    packed = centroids.pack_planes(np.array(rows, dtype=np.int64), planes)
    assert centroids.unpack_planes(packed).tolist() == rows
    wanted = [[sum(x * y for x, y in zip(a, b, strict=True)) for b in rows] for a in rows]
    assert centroids.dot_products(packed, packed).tolist() == wanted
    assert centroids.squared_lengths(packed).tolist() == [wanted[k][k] for k in range(len(rows))]


# Prefix trie ---------------------------------------------------------------------------------------------------------


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    turns = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        family = c - int(math.fmod(c, 5))
        path = tuple(turns.get(family, [])[:h] + turns[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(path, [])))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        leaves = sum(not children[p] for p in below)
        out.append((min(convs), len(path), parent, len(convs), len(children[path]), leaves, saved, digest))
    return out


def talks(spark, rows, partitions=4):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(partitions)


def random_talks(rng, many, most=12, alphabet="ab"):
    rows = []
    for _ in range(many):
        conv = rng.randint(-20, 60)
        for turn in range(rng.randint(0, most)):
            rows.append((conv, turn, rng.choice(["u", "a"]), rng.choice(["", *alphabet, "é" * 3])))
    return rows


@pytest.mark.parametrize("block_turns", [1, 7, 60, 1 << 17])
def test_tries_equal_plain_ones_whatever_the_blocks(spark, block_turns):
    rng = random.Random(block_turns)
    rows = random_talks(rng, 60)
    rows += [(c, t, "u", f"hello {t}") for c in range(100, 160) for t in range(3)]  # a group of copies
    rows += [(None, 0, "u", "x"), (200, None, None, None), (200, 3, "u", None), (200, 3, None, "z"), (200, 3, "u", None), (205, 1, "u", "w" * 100_000)]
    found = conversation_trie.prefix_trie(talks(spark, rows), block_turns).collect()
    assert shown(found) == shown(plain_trie(rows))


def test_long_conversations_and_empty_tables(spark):
    rows = [(5, t, "u", str(t % 3)) for t in range(300)] + [(6, t, "u", str(t % 3)) for t in range(290)] + [(7, 0, "u", "0")]
    assert shown(conversation_trie.prefix_trie(talks(spark, rows), 100).collect()) == shown(plain_trie(rows))
    assert conversation_trie.prefix_trie(talks(spark, rows).limit(0)).collect() == []
    # a conversation that takes over more turns than it has itself, from one that is absent, has none
    lone = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    assert shown(conversation_trie.prefix_trie(talks(spark, [(lone, 0, "u", "x")])).collect()) == shown(plain_trie([(lone, 0, "u", "x")]))


def test_pieces_of_the_identifiers_of_copies(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_BYTES", 20)
    rows = [(c, t, "u", "same") for c in range(0, 1500, 5) for t in range(2)]
    assert shown(conversation_trie.prefix_trie(talks(spark, rows)).collect()) == shown(plain_trie(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=40), st.integers(0, 4))
def test_extents_are_those_of_a_scan(values, depth):
    values = np.array([-1, *values[1:]])
    at = np.arange(len(values))
    left, right = conversation_trie.RangeMinimum(values).extents(at, np.full(len(values), depth))
    for k in at.tolist():
        first = k
        while first and values[first] >= depth:
            first -= 1
        last = k
        while last + 1 < len(values) and values[last + 1] >= depth:
            last += 1
        assert (left[k], right[k]) == (first, last)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(-50, 50), min_size=1, max_size=40), st.data())
def test_least_of_a_range(values, data):
    first = data.draw(st.integers(0, len(values) - 1))
    last = data.draw(st.integers(first, len(values) - 1))
    table = conversation_trie.RangeMinimum(np.array(values))
    assert table.least(np.array([first]), np.array([last])).tolist() == [min(values[first : last + 1])]
