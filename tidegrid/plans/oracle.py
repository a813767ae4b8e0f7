"""SQL twins of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from collections.abc import Sequence

from tidegrid.plans.lexicon import lexicon_sql

DIGITS = 6

TICKS = """ticks AS (SELECT event_type AS symbol, ts, event_id AS seq, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size FROM events)"""


def _bars_sql(label: str) -> str:
    return f"""SELECT symbol, {label} AS t,
  first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, seq) AS close,
  sum(size) AS v, count(*) AS n, CASE WHEN sum(size) = 0 THEN NULL ELSE sum(price * size) / sum(size) END AS vw"""


BARS = f"""{TICKS},
bars AS MATERIALIZED ({_bars_sql("time_bucket(INTERVAL 30 MINUTE, ts)")} FROM ticks GROUP BY 1, 2),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS rows_all FROM bars)"""

WIDE = f"""wide_ticks AS (SELECT l_suppkey AS symbol, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS seq,
  l_extendedprice / l_quantity AS price, l_quantity AS size FROM lineitem),
wide_bars AS ({_bars_sql("time_bucket(INTERVAL 1 DAY, ts)")} FROM wide_ticks GROUP BY 1, 2)"""

ARTICLES = """articles AS (SELECT doc_id AS article_id,
  ['click', 'error', 'purchase', 'signup', 'view'][CAST(doc_id % 5 + 1 AS INTEGER)] AS symbol,
  TIMESTAMP '2024-01-01' + to_minutes(CAST((doc_id * 37) % 43200 AS INTEGER)) AS created_at,
  substring(text, 1, 80) AS headline, text AS content FROM documents)"""

SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def _strip(value: str) -> str:
    return f"regexp_replace({value}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _strip_html(value: str) -> str:
    bare = rf"regexp_replace(regexp_replace({value}, '<[^>]*>', '', 'g'), '\n+', chr(10), 'g')"
    return _strip(f"replace(replace(replace({bare}, '&nbsp;', ' '), '&mdash;', '—'), '&ndash;', '–')")


def _clean_html(value: str) -> str:
    blocks = "|".join(rf"<{e}\b[^>]*>.*?</{e}\s*>" for e in ("script", "style", "template"))
    hidden = rf"(?is)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<![^>]*>|<\?[^>]*>|{blocks}"
    visible = f"regexp_replace(regexp_replace({value}, '{hidden}', '', 'g'), '(?s)</?[a-zA-Z][^>]*>', '', 'g')"
    for entity, character in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        visible = f"replace({visible}, '&{entity};', '{character}')"
    return _strip(f"regexp_replace({visible}, '{SPACE}+', ' ', 'g')")


def _tokens(value: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({value}), '[^\p{{L}}\p{{N}}_]+'), lambda x: x <> '')"


def _scored(text: str, source: str) -> str:
    """CTEs ``words``, ``sums``, ``scored`` over ``source(article_id, ...)``."""
    sums = ", ".join(f"sum(CASE WHEN class = '{c}' THEN weight ELSE 0 END) AS s_{c}" for c in CLASSES)
    top = "greatest(" + ", ".join(f"coalesce(s_{c}, 0)" for c in CLASSES) + ")"
    powers = {c: f"exp(coalesce(s_{c}, 0) - {top})" for c in CLASSES}
    total = " + ".join(powers.values())
    shares = ", ".join(f"{p} / ({total}) AS {c}" for c, p in powers.items())
    scores = ", ".join(f"coalesce(s_{c}, 0) AS score_{c}" for c in CLASSES)
    return f"""{lexicon_sql()},
words AS (SELECT article_id, unnest({_tokens(text)}) AS word FROM {source}),
sums AS (SELECT article_id, {sums} FROM words JOIN lexicon USING (word) GROUP BY 1),
scored AS (SELECT a.*, {scores}, {shares} FROM {source} a LEFT JOIN sums USING (article_id))"""


CLASSES = ("positive", "negative", "neutral")

SENTIMENT = f"""{ARTICLES},
{_scored("concat_ws(' ', headline, " + _strip_html("content") + ")", "articles")},
sentiment AS MATERIALIZED (SELECT symbol, date_trunc('minute', created_at) AS t, article_id, positive, negative, neutral,
  rpad(headline, 100, ' ') AS headline FROM scored)"""


def _round(columns: Sequence[str], digits: int = DIGITS) -> str:
    return ", ".join(f"{_shown(c, digits)} AS {c}" for c in columns)


def _shown(value: str, digits: int = DIGITS) -> str:
    """Rounded in the same steps as the queries."""
    scale = f"{10.0**digits:.1e}"
    return f"floor(({value}) * {scale} + 5.03e-1) / {scale}"


def _roll(function: str, value: str, rows: int) -> str:
    return f"{function}({value}) OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def _lag(value: str, rows: int = 1) -> str:
    return f"lag({value}, {rows}) OVER (PARTITION BY symbol ORDER BY i)"


def _from(row: int, value: str) -> str:
    return f"CASE WHEN i >= {row} THEN {value} END"


def _average(name: str, source: str, value: str, seed: str, start: int, weight: float) -> str:
    """Recursive CTE ``name(symbol, i, y)``: exponential average of ``value`` from ``seed`` at row ``start``."""
    return f"""{name} AS (SELECT symbol, i, {seed} AS y FROM {source} WHERE i = {start}
  UNION ALL SELECT s.symbol, s.i, {weight!r} * s.{value} + {1 - weight!r} * r.y
  FROM {name} r JOIN {source} s ON s.symbol = r.symbol AND s.i = r.i + 1)"""


def _indicator(ctes: str, select: str, outputs: Sequence[str], source: str = "f") -> str:
    return f"WITH RECURSIVE {BARS}, {ctes}, shown AS (SELECT symbol, t, {select} FROM {source}) SELECT symbol, t, {_round(outputs)} FROM shown"


ORIGINAL = ["open", "high", "low", "close", "v", "n", "vw"]

TYPICAL = "((high + low + close) / 3)"

# Pieces of the indicators: CTEs, and an expression per output over ``f`` (bars with the pieces joined).
INDICATORS: dict[str, tuple[str, str, list[str]]] = {}


def _ema_twin(period: int) -> tuple[str, str, list[str]]:
    return (
        f"""e0 AS MATERIALIZED (SELECT *, {_roll("avg", "close", period)} AS seed FROM b),
{_average("smooth", "e0", "close", "seed", period - 1, 2 / (period + 1))},
f AS (SELECT b.*, y FROM b LEFT JOIN smooth USING (symbol, i))""",
        f"y AS EMA{period}",
        [f"EMA{period}"],
    )


def _rsi_twin(period: int) -> tuple[str, str, list[str]]:
    return (
        f"""d0 AS (SELECT *, close - {_lag("close")} AS d FROM b),
d1 AS (SELECT *, CASE WHEN i > 0 THEN greatest(d, 0) END AS g, CASE WHEN i > 0 THEN greatest(-d, 0) END AS l FROM d0),
d2 AS MATERIALIZED (SELECT *, {_roll("avg", "g", period)} AS gm, {_roll("avg", "l", period)} AS lm FROM d1),
{_average("gains", "d2", "g", "gm", period, 1 / period)},
{_average("losses", "d2", "l", "lm", period, 1 / period)},
f AS (SELECT b.*, gains.y AS g, losses.y AS l FROM b LEFT JOIN gains USING (symbol, i) LEFT JOIN losses USING (symbol, i))""",
        "CASE WHEN g + l < 1e-8 THEN 0 ELSE 100 * g / (g + l) END AS RSI",
        ["RSI"],
    )


def _define_indicators() -> None:
    def simple(name: str, outputs: dict[str, str], inner: str = "") -> None:
        ctes = f"f AS (SELECT *{', ' + inner if inner else ''} FROM b)"
        INDICATORS[name] = (ctes, ", ".join(f"{e} AS {o}" for o, e in outputs.items()), list(outputs))

    simple("sma", {f"MA{p}": _from(p - 1, _roll("avg", "close", p)) for p in (20, 50, 200)})
    weights = " + ".join(f"{20 - j} * {_lag('close', j)}" for j in range(1, 20))
    simple("wma", {"WMA20": _from(19, f"(20 * close + {weights}) / 210")})
    simple(
        "bollinger",
        {
            "UpperBB": _from(19, "m + 2 * s"),
            "MiddleBB": _from(19, "m"),
            "LowerBB": _from(19, "m - 2 * s"),
        },
        f"{_roll('avg', 'close', 20)} AS m, "
        f"CASE WHEN {_roll('var_pop', 'close', 20)} < 1e-8 THEN 0 ELSE sqrt({_roll('var_pop', 'close', 20)}) END AS s",
    )
    simple(
        "pivot_points",
        {
            "PP": "p", "R1": "2 * p - low", "S1": "2 * p - high", "R2": "p + (high - low)", "S2": "p - (high - low)",
            "R3": "high + 2 * (p - low)", "S3": "low - 2 * (high - p)",
        },
        f"{TYPICAL} AS p",
    )
    simple(
        "roc",
        {"ROC": _from(10, "CASE WHEN c10 = 0 THEN 0 ELSE (close / c10 - 1) * 100 END")},
        f"{_lag('close', 10)} AS c10",
    )
    simple(
        "ichimoku",
        {
            "Tenkan": _from(8, "m9"),
            "Kijun": _from(25, "m26"),
            "SenkouA": _from(51, _lag("(m9 + m26) / 2", 26)),
            "SenkouB": _from(77, _lag("m52", 26)),
            "Chikou": "lead(close, 26) OVER (PARTITION BY symbol ORDER BY i)",
        },
        ", ".join(f"({_roll('max', 'high', p)} + {_roll('min', 'low', p)}) / 2 AS m{p}" for p in (9, 26, 52)),
    )
    spread = " + ".join([f"abs({TYPICAL} - m)"] + [f"abs(p{j} - m)" for j in range(1, 14)])
    INDICATORS["cci"] = (
        f"f0 AS (SELECT *, {_roll('avg', TYPICAL, 14)} AS m, "
        + ", ".join(f"{_lag(TYPICAL, j)} AS p{j}" for j in range(1, 14))
        + f" FROM b), f AS (SELECT *, ({spread}) / 14 AS d FROM f0)",
        f"{_from(13, f'CASE WHEN {TYPICAL} = m OR d = 0 THEN 0 ELSE ({TYPICAL} - m) / (0.015 * d) END')} AS CCI",
        ["CCI"],
    )
    INDICATORS["obv"] = (
        f"f AS (SELECT *, CASE WHEN i = 0 THEN v ELSE sign(close - {_lag('close')}) * v END AS flow FROM b)",
        "sum(flow) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS OBV",
        ["OBV"],
    )
    INDICATORS["mfi"] = (
        f"""f0 AS (SELECT *, {TYPICAL} AS tp, {_lag(TYPICAL)} AS tp1 FROM b),
f1 AS (SELECT *, CASE WHEN tp > tp1 THEN tp * v ELSE 0 END AS up, CASE WHEN tp < tp1 THEN tp * v ELSE 0 END AS down FROM f0),
f AS (SELECT *, {_roll("sum", "up", 14)} AS u, {_roll("sum", "down", 14)} AS d FROM f1)""",
        f"{_from(14, 'CASE WHEN u + d < 1 THEN 0 ELSE 100 * u / (u + d) END')} AS MFI",
        ["MFI"],
    )
    INDICATORS["stochastic"] = (
        f"""f0 AS (SELECT *, {_roll("max", "high", 14)} AS hh, {_roll("min", "low", 14)} AS ll FROM b),
f1 AS (SELECT *, CASE WHEN hh = ll THEN 0 ELSE 100 * (close - ll) / (hh - ll) END AS fast FROM f0),
f AS (SELECT *, {_roll("avg", "fast", 3)} AS k FROM f1)""",
        f"{_from(17, 'k')} AS SlowK, {_from(17, _roll('avg', 'k', 3))} AS SlowD",
        ["SlowK", "SlowD"],
    )
    INDICATORS["ema"] = (
        f"""e0 AS MATERIALIZED (SELECT *, {_roll("avg", "close", 20)} AS m20 FROM b),
{_average("e20", "e0", "close", "m20", 19, 2 / 21)},
f AS (SELECT b.*, y FROM b LEFT JOIN e20 USING (symbol, i))""",
        "y AS EMA20",
        ["EMA20"],
    )
    INDICATORS["rsi"] = (
        f"""d0 AS (SELECT *, close - {_lag("close")} AS d FROM b),
d1 AS (SELECT *, CASE WHEN i > 0 THEN greatest(d, 0) END AS g, CASE WHEN i > 0 THEN greatest(-d, 0) END AS l FROM d0),
d2 AS MATERIALIZED (SELECT *, {_roll("avg", "g", 14)} AS g14, {_roll("avg", "l", 14)} AS l14 FROM d1),
{_average("gains", "d2", "g", "g14", 14, 1 / 14)},
{_average("losses", "d2", "l", "l14", 14, 1 / 14)},
f AS (SELECT b.*, gains.y AS g, losses.y AS l FROM b LEFT JOIN gains USING (symbol, i) LEFT JOIN losses USING (symbol, i))""",
        "CASE WHEN g + l < 1e-8 THEN 0 ELSE 100 * g / (g + l) END AS RSI",
        ["RSI"],
    )
    INDICATORS["macd"] = (
        f"""m0 AS MATERIALIZED (SELECT *, {_roll("avg", "close", 12)} AS m12, {_roll("avg", "close", 26)} AS m26 FROM b),
{_average("quick", "m0", "close", "m12", 25, 2 / 13)},
{_average("slow", "m0", "close", "m26", 25, 2 / 27)},
m1 AS (SELECT symbol, i, quick.y - slow.y AS m FROM quick JOIN slow USING (symbol, i)),
m2 AS MATERIALIZED (SELECT *, {_roll("avg", "m", 9)} AS m9 FROM m1),
{_average("sig", "m2", "m", "m9", 33, 0.2)},
f AS (SELECT b.*, m, y FROM b LEFT JOIN m2 USING (symbol, i) LEFT JOIN sig USING (symbol, i))""",
        f"{_from(33, 'm')} AS MACD, y AS Signal",
        ["MACD", "Signal"],
    )
    INDICATORS["atr"] = (
        f"""r0 AS (SELECT *, {_lag("close")} AS c1 FROM b),
r1 AS (SELECT *, CASE WHEN i > 0 THEN greatest(high - low, abs(high - c1), abs(low - c1)) END AS tr FROM r0),
r2 AS MATERIALIZED (SELECT *, {_roll("avg", "tr", 14)} AS tr14 FROM r1),
{_average("ranges", "r2", "tr", "tr14", 14, 1 / 14)},
f AS (SELECT b.*, y FROM b LEFT JOIN ranges USING (symbol, i))""",
        "y AS ATR",
        ["ATR"],
    )
    INDICATORS["chaikin"] = (
        f"""a0 AS (SELECT *, CASE WHEN high > low THEN ((close - low) - (high - close)) / (high - low) * v ELSE 0 END AS mf FROM b),
a1 AS MATERIALIZED (SELECT *, sum(mf) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS ad FROM a0),
{_average("a3", "a1", "ad", "ad", 0, 0.5)},
{_average("a10", "a1", "ad", "ad", 0, 2 / 11)},
f AS (SELECT b.*, a3.y - a10.y AS y FROM b JOIN a3 USING (symbol, i) JOIN a10 USING (symbol, i))""",
        f"{_from(9, 'y')} AS CMF",
        ["CMF"],
    )
    # State of the stop-and-reverse: up, the stop shown for the bar, the next stop, extreme and pace.
    INDICATORS["psar"] = (
        f"""p0 AS MATERIALIZED (SELECT *, {_lag("high")} AS h1, {_lag("low")} AS l1 FROM b),
p1 AS MATERIALIZED (SELECT symbol, i, high, low, CASE WHEN i = 1 THEN high ELSE greatest(high, h1) END AS hh,
  CASE WHEN i = 1 THEN low ELSE least(low, l1) END AS ll, h1, l1 FROM p0 WHERE i >= 1),
walk(symbol, i, up, shown, stop, extreme, pace) AS (
  SELECT symbol, CAST(0 AS BIGINT), NOT (l1 - low > 0 AND l1 - low > high - h1), CAST(NULL AS DOUBLE),
    CASE WHEN l1 - low > 0 AND l1 - low > high - h1 THEN h1 ELSE l1 END,
    CASE WHEN l1 - low > 0 AND l1 - low > high - h1 THEN low ELSE high END, CAST(0.02 AS DOUBLE) FROM p1 WHERE i = 1
  UNION ALL
  SELECT symbol, i, up2, shown, CASE WHEN up2 THEN least(raw, ll) ELSE greatest(raw, hh) END, ex2, pace2 FROM (
    SELECT *, shown + pace2 * (ex2 - shown) AS raw FROM (
      SELECT *, CASE WHEN turned THEN CASE WHEN up THEN greatest(extreme, hh) ELSE least(extreme, ll) END ELSE stop END AS shown,
        CASE WHEN turned THEN NOT up ELSE up END AS up2,
        CASE WHEN turned THEN CASE WHEN up THEN low ELSE high END WHEN up THEN greatest(extreme, high) ELSE least(extreme, low) END AS ex2,
        CASE WHEN turned THEN 0.02 WHEN (up AND high > extreme) OR (NOT up AND low < extreme) THEN least(pace + 0.02, 0.2) ELSE pace END AS pace2
      FROM (SELECT p.symbol, p.i, p.high, p.low, p.hh, p.ll, w.up, w.stop, w.extreme, w.pace,
          CASE WHEN w.up THEN p.low <= w.stop ELSE p.high >= w.stop END AS turned
        FROM walk w JOIN p1 p ON p.symbol = w.symbol AND p.i = w.i + 1)))),
f AS (SELECT b.*, walk.shown AS y FROM b LEFT JOIN walk USING (symbol, i))""",
        "y AS PSAR",
        ["PSAR"],
    )


_define_indicators()



def _bar_select(source: str, digits: int = DIGITS) -> str:
    prices = _round(["open", "high", "low", "close", "v"], digits)
    return f"SELECT symbol, t, {prices}, n, {_round(['vw'], digits)} FROM {source}"


def _minmax(name: str, source: str = "b", fit: str = "TRUE") -> str:
    value = f"CASE WHEN {fit} THEN {name} END"
    low, high = f"min({value}) OVER (PARTITION BY symbol)", f"max({value}) OVER (PARTITION BY symbol)"
    return f"CASE WHEN {high} = {low} THEN ({name} - {low}) ELSE ({name} - {low}) / ({high} - {low}) END AS {name}"


def _asof_price(right: str, left: str) -> str:
    return f"SELECT a.*, r.close FROM {left} a ASOF LEFT JOIN {right} r ON a.symbol = r.symbol AND a.t >= r.t"


NEAREST = f"""one_back AS (SELECT symbol, t, max_by(positive, article_id) AS positive, max_by(negative, article_id) AS negative,
  max_by(neutral, article_id) AS neutral FROM sentiment GROUP BY 1, 2),
one_ahead AS (SELECT symbol, t, min_by(positive, article_id) AS positive, min_by(negative, article_id) AS negative,
  min_by(neutral, article_id) AS neutral FROM sentiment GROUP BY 1, 2),
backward AS (SELECT b.symbol, b.t, r.t AS rt, r.positive, r.negative, r.neutral
  FROM b ASOF LEFT JOIN one_back r ON b.symbol = r.symbol AND b.t >= r.t),
forward AS (SELECT b.symbol, b.t, r.t AS rt, r.positive, r.negative, r.neutral
  FROM b ASOF LEFT JOIN one_ahead r ON b.symbol = r.symbol AND b.t <= r.t),
choice AS (SELECT symbol, t, x.rt IS NOT NULL AND (y.rt IS NULL OR t - x.rt <= y.rt - t) AS back, x, y
  FROM backward x JOIN forward y USING (symbol, t)),
near AS (SELECT symbol, t, {", ".join(
    f"CASE WHEN back AND t - x.rt <= INTERVAL 15 MINUTE THEN x.{c} WHEN NOT back AND y.rt - t <= INTERVAL 15 MINUTE THEN y.{c} END AS {c}"
    for c in CLASSES)} FROM choice)"""

MA20 = f"m AS (SELECT *, {_from(19, _roll('avg', 'close', 20))} AS MA20 FROM b)"


def _fills(kind: str) -> str:
    ahead = "PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    behind = "PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    parts = []
    for c in ("vw", "MA20"):
        last = f"last_value({c} IGNORE NULLS) OVER ({behind})"
        first = f"first_value({c} IGNORE NULLS) OVER ({ahead})"
        value = {"ffill": last, "bfill": first, "fill_both": f"coalesce({last}, {first})"}[kind]
        parts.append(f"{value} AS {c}")
    return f"WITH {BARS}, {MA20}, r AS (SELECT symbol, t, {', '.join(parts)} FROM m) SELECT symbol, t, {_round(['vw', 'MA20'])} FROM r"


SESSIONS = """sessions AS (SELECT DISTINCT CAST(ts AS DATE) AS session_date FROM events
  WHERE isodow(ts) <= 5 AND ts < TIMESTAMP '2024-01-31')"""


def _session(days_back: int | None, n: int) -> str:
    since = "" if days_back is None else f"WHERE session_date >= DATE '2024-01-30' - {days_back}"
    return f"SELECT session_date FROM sessions {since} ORDER BY 1 DESC LIMIT 1 OFFSET {n - 1}"


def _lines_score() -> str:
    return "SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b, l_quantity / 50 AS c FROM lineitem"


def _feature_scores() -> str:
    names = ["open", "high", "low", "v", "n"]
    scaled = ", ".join(_minmax(n) for n in [*names, "close"])
    fs = " UNION ALL ".join(
        f"SELECT symbol, '{n}' AS feature, regr_r2(close, {n}) AS r2, regr_count(close, {n}) AS cnt FROM s GROUP BY 1" for n in names
    )
    cells = " UNION ALL ".join(
        f"SELECT symbol, '{n}' AS feature, least(floor({n} * 10), 9) AS bx, least(floor(close * 10), 9) AS bw FROM s" for n in names
    )
    return f"""WITH {BARS}, s AS MATERIALIZED (SELECT symbol, {scaled} FROM b),
f AS ({fs}), cells AS ({cells}),
joint AS (SELECT symbol, feature, bx, bw, count(*) AS c FROM cells GROUP BY ALL),
marked AS (SELECT *, sum(c) OVER (PARTITION BY symbol, feature) AS n, sum(c) OVER (PARTITION BY symbol, feature, bx) AS nx,
  sum(c) OVER (PARTITION BY symbol, feature, bw) AS nw FROM joint),
mi AS (SELECT symbol, feature, sum(c / n * ln(c * n / (CAST(nx AS DOUBLE) * nw))) AS mi FROM marked GROUP BY 1, 2)
SELECT symbol, feature, {_shown('r2 * (cnt - 2) / (1 - r2)', 4)} AS f_score, {_shown('mi', 4)} AS mi,
  row_number() OVER (PARTITION BY symbol ORDER BY round(mi, 9) DESC, feature) AS place FROM f JOIN mi USING (symbol, feature)"""


FEATURES = [o for _, _, out in INDICATORS.values() for o in out if o not in ("R1", "S1", "R2", "S2", "R3", "S3")]

WIDE_BARS = f"""{WIDE},
bars AS MATERIALIZED (SELECT * FROM wide_bars),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS rows_all FROM bars)"""


def _feature_ctes() -> str:
    """CTE ``feat``: bars with all indicator columns, from the pieces of every indicator under names of their own."""
    parts, joins = [], []
    for name, (ctes, select, _) in INDICATORS.items():
        outer = f"WITH RECURSIVE {ctes} SELECT symbol AS {name}_s, t AS {name}_t, {select} FROM f"
        parts.append(f"{name}_part AS MATERIALIZED ({outer})")
        joins.append(f"JOIN {name}_part ON b.symbol = {name}_s AND b.t = {name}_t")
    columns = ", ".join(f"b.{c}" for c in ("symbol", "t", "i", *ORIGINAL))
    return f"{', '.join(parts)}, feat AS MATERIALIZED (SELECT {columns}, {', '.join(FEATURES)} FROM b {' '.join(joins)})"


def _features_all(bars: str = BARS, digits: int = DIGITS) -> str:
    prices = _round(["open", "high", "low", "close", "v"], digits)
    return f"""WITH {bars}, {_feature_ctes()}
SELECT symbol, t, {prices}, n, {_round(["vw"], digits)}, {_round(FEATURES, digits)} FROM feat"""


def _filled(columns: Sequence[str]) -> str:
    behind = "PARTITION BY symbol ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ahead = "PARTITION BY symbol ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    return ", ".join(
        f"coalesce(last_value({c} IGNORE NULLS) OVER ({behind}), first_value({c} IGNORE NULLS) OVER ({ahead})) AS {c}"
        for c in columns
    )


def _combined(then: str | None = None) -> str:
    """Scaled and filled features with the filled scores of the nearest article; ``then`` reads them as ``done``."""
    columns = [*ORIGINAL, *FEATURES]
    shown = then or f"\nSELECT symbol, t, {_round([*columns, *CLASSES])} FROM done"
    return f"""WITH {BARS}, {_feature_ctes()}, {SENTIMENT}, {NEAREST},
scaled AS (SELECT symbol, t, i, {", ".join(_minmax(c) for c in columns)} FROM feat),
whole AS (SELECT symbol, t, i, {_filled(columns)} FROM scaled),
matched AS (SELECT w.*, {", ".join(f"near.{c}" for c in CLASSES)} FROM whole w JOIN near USING (symbol, t)),
done AS MATERIALIZED (SELECT symbol, t, {", ".join(columns)}, {_filled(CLASSES)} FROM matched){shown}"""


def _feature_scores_all() -> str:
    """Mutual information with the close over ``ntile(10)``; equal values go to the bin of the first of them."""
    names = [*[c for c in ORIGINAL if c != "close"], *FEATURES, *CLASSES]
    tiles = "min(tile) OVER (PARTITION BY symbol, feature, x)"
    values = " UNION ALL ".join(f"SELECT symbol, t, '{n}' AS feature, {_shown(n)} AS x FROM done WHERE {n} IS NOT NULL" for n in [*names, "close"])
    return _combined(f""",
vals AS MATERIALIZED ({values}),
tiles AS (SELECT *, ntile(10) OVER (PARTITION BY symbol, feature ORDER BY x) AS tile FROM vals),
bins AS MATERIALIZED (SELECT symbol, t, feature, {tiles} AS bin FROM tiles),
joint AS (SELECT a.symbol, a.feature, a.bin AS bx, y.bin AS bw, count(*) AS c FROM bins a
  JOIN bins y ON y.feature = 'close' AND a.symbol = y.symbol AND a.t = y.t WHERE a.feature <> 'close' GROUP BY ALL),
marked AS (SELECT *, sum(c) OVER (PARTITION BY symbol, feature) AS n, sum(c) OVER (PARTITION BY symbol, feature, bx) AS nx,
  sum(c) OVER (PARTITION BY symbol, feature, bw) AS nw FROM joint),
mi AS (SELECT symbol, feature, sum(c / n * ln(CAST(c AS DOUBLE) * n / (CAST(nx AS DOUBLE) * nw))) AS mi FROM marked GROUP BY 1, 2)
SELECT symbol, feature, {_shown('mi')} AS mi, row_number() OVER (PARTITION BY symbol ORDER BY round(mi, 9) DESC, feature) AS place FROM mi""")


def oracle_sql() -> dict[str, str]:
    sql = {name: _indicator(ctes, select, outputs) for name, (ctes, select, outputs) in INDICATORS.items()}
    sql["ema_long"] = _indicator(*_ema_twin(200))
    sql["rsi_long"] = _indicator(*_rsi_twin(100))
    sql["features_all"] = _features_all()
    sql["features_wide"] = _features_all(WIDE_BARS, digits=3)
    sql["combined_features"] = _combined()
    for name in ("scan_bars", "union_pages", "bars_sink", "resample_bars", "sort_time", "stream_bars", "stream_bars_repaired"):
        sql[name] = f"WITH {BARS} {_bar_select('bars')}"
    sql["scan_bars"] = sql["scan_bars"].replace("SELECT symbol, t, floor", "SELECT upper(symbol) AS symbol, t, floor")
    sql["resample_coarser"] = (
        f"WITH {TICKS}, coarse AS ({_bars_sql('time_bucket(INTERVAL 4 HOUR, ts)')} FROM ticks GROUP BY 1, 2) {_bar_select('coarse')}"
    )
    sql["daily_ohlc"] = (
        f"WITH {TICKS}, days AS ({_bars_sql('date_trunc(' + chr(39) + 'day' + chr(39) + ', (ts AT TIME ZONE ' + chr(39) + 'UTC' + chr(39) + ') AT TIME ZONE ' + chr(39) + 'US/Eastern' + chr(39) + ')')}"
        f" FROM ticks GROUP BY 1, 2) SELECT symbol, CAST(t AS TIMESTAMP) AS t, {_round(['open', 'high', 'low', 'close', 'v'])}, n, {_round(['vw'])} FROM days"
    )
    sql["split_adjust"] = f"""WITH {WIDE},
splits AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_tax >= 0.04 THEN 2.0 ELSE 3.0 END AS ratio
  FROM lineitem WHERE l_linenumber = 7 AND l_quantity >= 49 AND l_returnflag = 'R'),
factors AS (SELECT w.symbol, w.t, product(CAST(ratio AS DOUBLE)) AS f FROM wide_bars w JOIN splits s ON s.symbol = w.symbol AND s.day > w.t GROUP BY 1, 2),
adjusted AS (SELECT w.symbol, w.t, open / coalesce(f, 1) AS open, high / coalesce(f, 1) AS high, low / coalesce(f, 1) AS low,
  close / coalesce(f, 1) AS close, v * coalesce(f, 1) AS v, n, vw / coalesce(f, 1) AS vw FROM wide_bars w LEFT JOIN factors USING (symbol, t))
{_bar_select("adjusted")}"""
    sql["scan_news"] = f"""WITH {ARTICLES} SELECT article_id, upper(symbol) AS symbol, created_at, headline, content FROM articles
WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' AND length(content) > 0 ORDER BY created_at DESC"""
    place = "(row_number() OVER (PARTITION BY symbol ORDER BY created_at DESC, article_id DESC) - 1)"
    for name in ("paged_news", "stream_paged_news"):
        sql[name] = f"""WITH {ARTICLES} SELECT article_id, upper(symbol) AS symbol, created_at, headline, content, {place} // 50 AS page,
  CAST({place} % 50 AS INTEGER) AS place FROM articles"""
    eastern = "CAST((moment AT TIME ZONE 'UTC') AT TIME ZONE 'US/Eastern' AS TIMESTAMP)"
    sql["time_to_eastern"] = f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS moment FROM lineitem),
e AS (SELECT *, {eastern} AS eastern FROM x)
SELECT l_orderkey, l_linenumber, eastern, strftime(eastern, '%Y-%m-%dT%H:%M:%S') ||
  CASE WHEN moment - eastern = INTERVAL 4 HOUR THEN '-04:00' ELSE '-05:00' END AS iso FROM e"""
    sql["floor_minute"] = "SELECT event_id, upper(event_type) AS symbol, date_trunc('minute', ts) AS minute FROM events"
    sql["news_with_content"] = f"""WITH c AS (SELECT page_id AS article_id, {_clean_html("html")} AS content FROM pages)
SELECT article_id, CAST(length(content) AS INTEGER) AS length FROM c WHERE length(content) > 0"""
    sql["positive_negative_news"] = f"""WITH {SENTIMENT} SELECT symbol, t, article_id, {_round(["positive", "negative"])},
  CASE WHEN positive > 0.5 THEN 'positive' ELSE 'negative' END AS kind FROM sentiment WHERE positive > 0.5 OR negative > 0.5"""
    sql["date_range_filter"] = f"""WITH {TICKS} SELECT symbol, ts, seq, {_round(["price", "size"])} FROM ticks
WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00'"""
    sql["strip_html"] = f"SELECT page_id AS article_id, {_strip_html('html')} AS text FROM pages"
    sql["clean_html_text"] = f"SELECT page_id AS article_id, {_clean_html('html')} AS text FROM pages"
    joined = "concat_ws(' ', headline, content)"
    sql["prepare_text"] = f"WITH {ARTICLES} SELECT article_id, array_to_string(({_tokens(joined)}), ' ') AS text FROM articles"
    sql["headline_pad"] = "SELECT doc_id AS article_id, rpad(text, 100, ' ') AS headline FROM documents"
    sql["softmax3"] = f"""WITH s AS ({_lines_score()}), p AS (SELECT *, exp(a) + exp(b) + exp(c) AS z FROM s),
q AS (SELECT l_orderkey, l_linenumber, exp(a) / z AS positive, exp(b) / z AS negative, exp(c) / z AS neutral FROM p)
SELECT l_orderkey, l_linenumber, {_round(CLASSES)} FROM q"""
    sql["argmax_label"] = f"""WITH s AS ({_lines_score()}) SELECT l_orderkey, l_linenumber,
  CASE WHEN a >= b AND a >= c THEN 'positive' WHEN b >= c THEN 'negative' ELSE 'neutral' END AS label FROM s"""
    sql["sentiment_lexicon"] = f"WITH {ARTICLES}, {_scored('content', 'articles')} SELECT article_id, {_round(CLASSES)} FROM scored"
    p, m, z = (f"round(score_{c}, 9)" for c in CLASSES)
    label = f"CASE WHEN {p} >= {m} AND {p} >= {z} THEN 'positive' WHEN {m} >= {z} THEN 'negative' ELSE 'neutral' END"
    sql["sentiment_label"] = f"WITH {ARTICLES}, {_scored('content', 'articles')} SELECT article_id, {label} AS sentiment FROM scored"
    cleaned = f"""cleaned AS MATERIALIZED (SELECT article_id, created_at, {_clean_html("headline")} AS headline,
  {_clean_html("content")} AS content FROM articles), kept AS (SELECT * FROM cleaned WHERE length(content) > 0)"""
    sql["labelled_articles"] = f"""WITH {ARTICLES}, {cleaned}, {_scored("content", "kept")}
SELECT created_at, headline, content, {label} AS sentiment FROM scored"""
    sql["sentiment_series"] = f"WITH {SENTIMENT} SELECT symbol, t, article_id, {_round(CLASSES)}, headline FROM sentiment"
    sql["stream_news_sentiment"] = f"""WITH {SENTIMENT}, means AS (SELECT symbol, t, count(*) AS articles, avg(positive) AS positive,
  avg(negative) AS negative, avg(neutral) AS neutral FROM sentiment GROUP BY 1, 2) SELECT symbol, t, articles, {_round(CLASSES)} FROM means"""
    sql["minmax_scale"] = f"WITH {BARS}, s AS (SELECT symbol, t, {', '.join(_minmax(c) for c in ORIGINAL)} FROM b) SELECT symbol, t, {_round(ORIGINAL)} FROM s"
    sql["minmax_inverse"] = f"WITH {BARS} SELECT symbol, t, {_round(['close'])} FROM bars"
    fit = "i < rows_all - ceil(rows_all * 0.2)"
    sql["fit_scaler_train_only"] = f"""WITH {BARS}, s AS (SELECT symbol, t, {_minmax("close", fit=fit)}, {_minmax("v", fit=fit)} FROM b)
SELECT symbol, t, {_round(["close", "v"])} FROM s"""
    sql |= {kind: _fills(kind) for kind in ("ffill", "bfill", "fill_both")}
    sql["asof_nearest"] = f"""WITH {BARS}, {SENTIMENT}, {NEAREST}
SELECT b.symbol, b.t, {_round(["close"])}, {_round(CLASSES)} FROM b JOIN near USING (symbol, t)"""
    sql["feature_union"] = f"""WITH {BARS}, {SENTIMENT}, {NEAREST}
SELECT b.symbol, b.t, {_round(["close", "v"])}, {_round(CLASSES)} FROM b JOIN near USING (symbol, t)"""
    lefts = "lefts AS (SELECT article_id, symbol, created_at AS t FROM articles)"
    sql["asof_price"] = f"""WITH {BARS}, {ARTICLES}, {lefts}, r AS ({_asof_price("bars", "lefts")})
SELECT article_id, symbol, t, {_round(["close"])} FROM r"""
    sql["asof_complete_rows"] = f"""WITH {BARS}, {ARTICLES}, {lefts},
whole AS (SELECT symbol, t, close FROM b WHERE i >= 199 AND i < rows_all - 26), r AS ({_asof_price("whole", "lefts")})
SELECT article_id, symbol, t, {_round(["close"])} FROM r"""
    sql["news_markers"] = f"""WITH {BARS}, {SENTIMENT},
lefts AS (SELECT symbol, t, article_id, CASE WHEN positive > 0.5 THEN 'positive' ELSE 'negative' END AS kind
  FROM sentiment WHERE positive > 0.5 OR negative > 0.5),
r AS ({_asof_price("bars", "lefts")}) SELECT symbol, t, article_id, kind, {_round(["close"])} FROM r"""
    base = f"WITH {BARS}, p AS (SELECT *, close AS actual, {_lag('close')} AS predicted FROM b)"
    sql["regression_metrics"] = f"""{base}, q AS (SELECT symbol, count(*) AS n, avg((actual - predicted) ** 2) AS mse,
  avg(abs(actual - predicted)) AS mae, 1 - avg((actual - predicted) ** 2) / var_pop(actual) AS r2 FROM p WHERE predicted IS NOT NULL GROUP BY 1)
SELECT symbol, n, {_round(["mse", "mae", "r2"])} FROM q"""
    sql["scaled_loss"] = f"""WITH {BARS}, s AS (SELECT symbol, i, rows_all, {_minmax("close")} FROM b),
p AS (SELECT *, {_lag("close")} AS predicted FROM s)
SELECT symbol, {_shown('avg((close - predicted) ** 2)', 9)} AS loss FROM p WHERE i >= rows_all - ceil(rows_all * 0.2) GROUP BY 1"""
    sql["price_overlay"] = f"""{base} SELECT symbol, t, {_round(["close"])},
  CASE WHEN i >= rows_all - ceil(rows_all * 0.2) THEN {_shown('actual')} END AS actual,
  CASE WHEN i >= rows_all - ceil(rows_all * 0.2) THEN {_shown('predicted')} END AS predicted FROM p"""
    sql["article_counts"] = f"WITH {ARTICLES} SELECT symbol, CAST(created_at AS DATE) AS day, count(*) AS articles FROM articles GROUP BY 1, 2"
    sql["tail_n"] = f"WITH {BARS} SELECT symbol, t, {_round(['close'])} FROM b WHERE i >= rows_all - ceil(greatest(rows_all - 60, 0) * 0.2)"
    sql["nth_last_session"] = f"WITH {SESSIONS} {_session(None, 5)}"
    sql["session_before_days"] = f"WITH {SESSIONS} {_session(10, 5)}"
    sql["news_window"] = f"""WITH {SESSIONS}, {ARTICLES} SELECT article_id, symbol, created_at FROM articles
WHERE CAST(created_at AS DATE) BETWEEN ({_session(8, 4)}) AND ({_session(2, 1)})"""
    sql["news_series_window"] = f"""WITH {SESSIONS}, {ARTICLES} SELECT article_id, symbol, created_at FROM articles
WHERE CAST(created_at AS DATE) BETWEEN ({_session(10, 5)}) AND DATE '2024-01-30'"""
    window = "OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"
    sql["sequences"] = f"""WITH {BARS}, s AS (SELECT symbol, t, i, count(*) {window} AS length, first_value(open) {window} AS first_open,
  last_value(v) {window} AS last_v, sum(open + close + v) {window} AS total, close AS y FROM b)
SELECT symbol, t, length, {_round(["first_open", "last_v", "total", "y"])} FROM s WHERE i >= 60"""
    sql["label_shift"] = f"""WITH {BARS}, s AS (SELECT symbol, t, close, lead(close, 10) OVER (PARTITION BY symbol ORDER BY i) AS label FROM b)
SELECT symbol, t, {_round(["close", "label"])} FROM s WHERE label IS NOT NULL"""
    sql["time_split"] = f"""WITH {BARS} SELECT symbol, t, {_shown('close')} AS y,
  CASE WHEN i - 60 < rows_all - 60 - ceil((rows_all - 60) * 0.2) THEN 'train' ELSE 'test' END AS split FROM b WHERE i >= 60"""
    sql["shuffled_split"] = f"""WITH {BARS}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol
  ORDER BY substr(md5(symbol || '|' || epoch_us(t) || '|42'), 1, 15), i) - 1 AS place FROM b)
SELECT symbol, t, {_shown('close')} AS close,
  CASE WHEN place < ceil(rows_all * 0.2) THEN 'test' ELSE 'train' END AS split FROM r"""
    sql["validation_split"] = f"""WITH {BARS}, c AS (SELECT *, rows_all - ceil(rows_all * 0.2) AS train FROM b)
SELECT symbol, t, {_round(["close"])}, CASE WHEN i < floor(train * 0.8) THEN 'train' WHEN i < train THEN 'validation' ELSE 'test' END AS split FROM c"""
    sql["time_folds"] = f"""WITH {BARS}, c AS (SELECT *, rows_all // 6 AS size FROM b)
SELECT symbol, t, {_round(["close"])}, CAST(CASE WHEN i < rows_all - 5 * size THEN 0 ELSE (i - (rows_all - 5 * size)) // size + 1 END AS INTEGER) AS fold FROM c"""
    sql["feature_scores"] = _feature_scores()
    sql["feature_scores_all"] = _feature_scores_all()
    online = {n: INDICATORS[n] for n in ("ema", "rsi", "psar")}
    parts = ", ".join(
        f"{n}_part AS MATERIALIZED (WITH RECURSIVE {ctes} SELECT symbol AS {n}_s, t AS {n}_t, {select} FROM f)" for n, (ctes, select, _) in online.items()
    )
    joins = " ".join(f"JOIN {n}_part ON bars.symbol = {n}_s AND bars.t = {n}_t" for n in online)
    sql["stream_online_indicators"] = f"WITH {BARS}, {parts} SELECT bars.symbol, bars.t, {_round(['close', 'EMA20', 'RSI', 'PSAR'])} FROM bars {joins}"
    return sql
