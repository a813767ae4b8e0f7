"""One query per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm.centroids import CENTROIDS, ROUNDS, centroid_clusters
from tidegrid.llm.conversation_trie import prefix_trie
from tidegrid.llm.decontaminate import contamination
from tidegrid.llm.ngram_join import ngram_jaccard_components
from tidegrid.llm.packing import pack_documents
from tidegrid.llm.pii import personal_data
from tidegrid.llm.quality import quality_scores
from tidegrid.llm.secrets import secret_scan
from tidegrid.llm.tables import table
from tidegrid.llm.toxicity import fit as fit_toxicity
from tidegrid.llm.toxicity import toxicity_scores
from tidegrid.llm.token_lengths import length_histogram, limits_table
from tidegrid.llm.url_rules import judged_urls
from tidegrid.llm.voronoi import exact_top_k
from tidegrid.llm.warc import archived_pages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


@register
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_jaccard_components(table(spark, folder, "documents"))


@register
def op8_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return limits_table(length_histogram(table(spark, folder, "documents")))


@register
def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"))


@register
def op2_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"))


@register
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity_scores(documents, fit_toxicity(documents, table(spark, folder, "labels")))


@register
def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan(table(spark, folder, "documents"))


@register
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data(table(spark, folder, "documents"))


@register
def op3_voronoi_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top_k(table(spark, folder, "embeddings"))


ORACLE_SQL["op3_voronoi_top_k"] = """
WITH points AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
    FROM points q JOIN points d ON q.vec_id <> d.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@register
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_SQL_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
ORACLE_SQL["op5_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[s + 1 : s + k], ' ') AS phrase
            FROM (SELECT item_id, w, k, unnest(range(len(w) - k + 1)) AS s FROM i)),
places AS (SELECT doc_id, w, unnest(range(len(w))) AS p FROM d),
seen AS (SELECT doc_id, p, k, array_to_string(w[p + 1 : p + k], ' ') AS phrase
         FROM places, (SELECT DISTINCT k FROM windows) WHERE p + k <= len(w)),
found AS (SELECT s.doc_id, s.p, s.k, x.item_id FROM seen s JOIN windows x ON s.phrase = x.phrase AND s.k = x.k),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit
         FROM (SELECT doc_id, unnest(range(p, p + k)) AS place FROM (SELECT DISTINCT doc_id, p, k FROM found)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@register
def op7_warc_normaliser(spark: SparkSession, folder: str) -> DataFrame:
    return archived_pages(table(spark, folder, "pages"))


@register
def op11_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"))


_SQL_FIRST_BLOCKED = """CASE WHEN regexp_matches(u, '/wp-login[.]php([^0-9a-z_.%-]|$)') THEN '/wp-login.php^'
    WHEN regexp_matches(u, '^[^:/?#]+://([^/?#]*[.])?(.|\\n)*-bets[.]') THEN '||*-bets.'
    WHEN regexp_matches(u, '^[^:/?#]+://([^/?#]*[.])?(.|\\n)*-pills[.]') THEN '||*-pills.'
    WHEN regexp_matches(u, '^[^:/?#]+://([^/?#]*[.])?adult-') THEN '||adult-'
    WHEN regexp_matches(u, '^[^:/?#]+://([^/?#]*[.])?ads-') THEN '||ads-'
    WHEN regexp_matches(u, '^[^:/?#]+://([^/?#]*[.])?casino-') THEN '||casino-'
    WHEN regexp_matches(u, '^[^:/?#]+://([^/?#]*[.])?spam-') THEN '||spam-' END"""
_SQL_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _sql_fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


ORACLE_SQL["op11_url_rules"] = f"""
WITH cut AS (
    SELECT page_id, coalesce(url, '') AS url, translate(coalesce(url, ''), {_SQL_SMALL}) AS u,
           CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
    FROM pages
), parts AS (
    SELECT page_id, u, translate(regexp_extract(rest, '^[^/?#]*'), {_SQL_SMALL}) AS host,
           regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
    FROM cut
), judged AS (
    SELECT *, CASE WHEN {_sql_fits('example.net', '/en/')} THEN 'example.net/en/'
                   WHEN {_sql_fits('example.com', '/de/')} THEN 'example.com/de/'
                   WHEN {_sql_fits('org', '/fr/')} THEN 'org/fr/'
                   WHEN {_sql_fits('net', '/')} THEN 'net/' END AS rule,
           CASE WHEN ends_with(u, '/robots.txt') THEN '/robots.txt|' ELSE {_SQL_FIRST_BLOCKED} END AS fitting
    FROM parts
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN fitting IS NULL OR fitting = '/robots.txt|' THEN 'allow' ELSE 'block' END AS verdict,
       CASE WHEN rule IS NULL THEN fitting END AS pattern
FROM judged
"""


@register
def op12_bit_plane_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return centroid_clusters(table(spark, folder, "embeddings"))


_SQL_NEAREST = """(SELECT r, min(struct_pack(d := far, c := c)) AS best FROM (
        SELECT p.r, c.c, CAST(list_inner_product(p.v, p.v) - 2 * list_inner_product(p.v, c.v) + list_inner_product(c.v, c.v) AS BIGINT) AS far
        FROM points p, c{0} c) GROUP BY r)"""


def _sql_round(n: int) -> str:
    return f"""a{n} AS (SELECT r, best.c AS c FROM {_SQL_NEAREST.format(n - 1)}),
m{n} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
        SELECT c, i, sum(x) AS s, count(*) AS n
        FROM (SELECT a.c, generate_subscripts(p.v, 1) AS i, unnest(p.v) AS x FROM a{n} a JOIN points p USING (r)) GROUP BY c, i) GROUP BY c),
c{n} AS (SELECT c{n - 1}.c, coalesce(m{n}.v, c{n - 1}.v) AS v FROM c{n - 1} LEFT JOIN m{n} USING (c))"""


ORACLE_SQL["op12_bit_plane_clusters"] = f"""
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) = 64
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), points AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, v FROM kept),
c0 AS MATERIALIZED (SELECT c, v FROM (
        SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, r) - 1 AS INTEGER) AS c, v FROM points)
    WHERE c < {CENTROIDS}),
{(',' + chr(10)).join(_sql_round(n) for n in range(1, ROUNDS + 1))},
final AS (SELECT r, best.c AS cluster, best.d AS distance FROM {_SQL_NEAREST.format(ROUNDS)})
SELECT vec_id, cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM final JOIN points USING (r) JOIN c{ROUNDS} c ON c.c = cluster
"""


@register
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie(table(spark, folder, "conversations"))


#: CRC-32 of a string of digits: eight shifts per character, as one fold.
_SQL_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split({0}, ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""
_SQL_TEXT = "coalesce(text, '')"
ORACLE_SQL["op13_conversation_trie"] = f"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, {_SQL_TEXT} AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5({_SQL_TEXT})) AS p
    FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS family, {_SQL_CRC.format('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), placed AS (
    SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.family AND p <= h
    UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND p > h
), numbered AS (
    SELECT conv_id, row_number() OVER w AS d, string_agg(md5(strlen(role) || ':' || role || ':' || text), '') OVER w AS name, strlen(text) AS size
    FROM placed WINDOW w AS (PARTITION BY conv_id ORDER BY p)
), members AS (
    SELECT conv_id, 0 AS d, '' AS name, 0 AS size FROM c UNION ALL SELECT conv_id, d, name, size FROM numbered
), nodes AS MATERIALIZED (
    SELECT name, d, substr(name, 1, 32 * greatest(d - 1, 0)) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size
    FROM members GROUP BY name, d
), children AS (SELECT above AS name, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY above),
sums AS (
    SELECT top AS name, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
        SELECT substr(n.name, 1, 32 * unnest(range(d + 1))) AS top, n_children IS NULL AS leaf, (n_convs - 1) * size AS saved
        FROM nodes n LEFT JOIN children USING (name)) GROUP BY top
), ends AS (
    SELECT name, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
    FROM (SELECT conv_id, arg_max(name, d) AS name FROM members GROUP BY conv_id) GROUP BY name
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, CASE WHEN n.d > 0 THEN p.conv_id END AS parent_conv_id, n.n_convs,
       CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM nodes n JOIN nodes p ON p.name = n.above JOIN sums s ON s.name = n.name
LEFT JOIN children k ON k.name = n.name LEFT JOIN ends e ON e.name = n.name
"""
