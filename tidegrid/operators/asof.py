"""As-of joins: every left row takes the right row nearest before, after or around it in time.

Both sides are cut into time buckets per key. A bucket gets the right rows of its own time span, plus those just
outside that its rows can still reach: within the tolerance, copies of right rows near its edges; without one, the
single nearest right row of all earlier (later) buckets. One exchange on (key, bucket) and one sorted pass per
direction then decide every row. A busy key spreads over its buckets.

Right rows are first reduced to one per (key, time), and left rows are looked up once per distinct time where they
may repeat, so copies at one instant never pile up in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.series import DEFAULT_BUCKET_SECONDS, time_bucket

_SIDE, _BUCKET, _WHEN = "_side", "_bucket", "_when"


def _micros(time: str) -> Column:
    return F.unix_micros(F.col(time))


def _reduced(right: DataFrame, key: str, time: str, payload: Sequence[str], tie: str, sides: Sequence[str]) -> DataFrame:
    """One right row per (key, time): the last by ``tie`` for looking back, the first for looking ahead."""
    picks = {"_back": F.max_by, "_ahead": F.min_by}
    return right.groupBy(key, time).agg(
        *[picks[side](name, F.col(tie)).alias(f"{side}_{name}") for side in sides for name in payload]
    )


def _within_tolerance(right: DataFrame, time: str, seconds: int, tolerance: int, sides: Sequence[str]) -> DataFrame:
    """Right rows copied to each bucket with left rows that can still reach them."""
    width = seconds * 1_000_000
    reach = tolerance * 1_000_000
    low = _micros(time) - reach if "_ahead" in sides else _micros(time)
    high = _micros(time) + reach if "_back" in sides else _micros(time)
    return right.withColumn(_BUCKET, F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def _unlimited(
    right: DataFrame, left_buckets: DataFrame, key: str, time: str, seconds: int, sides: Sequence[str]
) -> DataFrame:
    """Right rows of the bucket itself, and for buckets with left rows the nearest right rows from outside."""
    home = right.withColumn(_BUCKET, time_bucket(time, seconds))
    values = [name for name in right.columns if name != key]
    ends = {"_back": F.max_by, "_ahead": F.min_by}
    edges = home.groupBy(key, _BUCKET).agg(
        *[ends[side](name, _micros(time)).alias(f"{side}{name}") for side in sides for name in values]
    )
    edges = edges.select(
        key, _BUCKET, *[F.struct(*[F.col(f"{side}{n}").alias(n) for n in values]).alias(f"_edge{side}") for side in sides]
    )
    seen = {
        side: Window.partitionBy(key)
        .orderBy(F.col(_BUCKET) if side == "_back" else F.col(_BUCKET).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
        for side in sides
    }
    carried = (
        left_buckets.select(key, _BUCKET, F.lit(True).alias("_wanted"))
        .join(edges, [key, _BUCKET], "full_outer")
        .withColumns({f"_carry{s}": F.last(f"_edge{s}", ignorenulls=True).over(seen[s]) for s in sides})
        .filter("_wanted")
        .select(key, _BUCKET, F.explode(F.array(*[f"_carry{s}" for s in sides])).alias("_carry"))
        .filter(F.col("_carry").isNotNull())
        .select(key, _BUCKET, "_carry.*")
    )
    return home.unionByName(carried)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    payload: Sequence[str],
    direction: str = "backward",
    tolerance_seconds: int | None = None,
    key: str = "symbol",
    time: str = "t",
    tie: str = "article_id",
    bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
    left_repeats: bool = False,
) -> DataFrame:
    """Left rows with the payload columns of their as-of match, NULL where there is none.

    Equal distance goes to the earlier right row; of several right rows at one time the highest ``tie`` is taken
    looking back and the lowest looking ahead. ``left_repeats`` says that many left rows may share a time.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction!r}")
    if left_repeats:
        times = left.select(key, time).distinct()
        looked_up = asof_join(
            times, right, payload, direction, tolerance_seconds, key, time, tie, bucket_seconds, left_repeats=False
        )
        return left.join(looked_up, [key, time], "left")

    seconds = max(bucket_seconds, tolerance_seconds or 0)
    columns = left.columns
    sides = {"backward": ["_back"], "forward": ["_ahead"], "nearest": ["_back", "_ahead"]}[direction]
    right = _reduced(right.dropna(subset=[key, time]), key, time, payload, tie, sides)
    if tolerance_seconds is None:
        buckets = left.select(key, time_bucket(time, seconds).alias(_BUCKET)).distinct()
        right = _unlimited(right, buckets, key, time, seconds, sides)
    else:
        right = _within_tolerance(right, time, seconds, tolerance_seconds, sides)
    found = [
        F.struct(F.col(time).alias(_WHEN), *[F.col(f"{side}_{n}").alias(n) for n in payload]).alias(f"_found{side}")
        for side in sides
    ]
    both = left.withColumns({_SIDE: F.lit(0), _BUCKET: time_bucket(time, seconds)}).unionByName(
        right.select(key, _BUCKET, time, F.lit(1).alias(_SIDE), *found), allowMissingColumns=True
    )
    passes = {
        side: Window.partitionBy(key, _BUCKET)
        .orderBy(F.col(time) if side == "_back" else F.col(time).desc(), F.col(_SIDE).desc())
        .rowsBetween(Window.unboundedPreceding, 0)
        for side in sides
    }
    for side in sides:
        both = both.withColumn(side, F.last(f"_found{side}", ignorenulls=True).over(passes[side])).drop(f"_found{side}")
    result = both.filter(F.col(_SIDE) == 0)

    gap = {side: F.abs(_micros(time) - F.unix_micros(F.col(f"{side}.{_WHEN}"))) for side in sides}
    if direction == "nearest":
        use_back = F.col("_ahead").isNull() | (gap["_back"] <= gap["_ahead"])
        chosen = F.when(F.col("_back").isNotNull() & use_back, F.col("_back")).otherwise(F.col("_ahead"))
    else:
        chosen = F.col(sides[0])
    if tolerance_seconds is not None:
        result = result.withColumn("_chosen", chosen)
        distance = F.abs(_micros(time) - F.unix_micros(F.col(f"_chosen.{_WHEN}")))
        result = result.withColumn("_chosen", F.when(distance <= tolerance_seconds * 1_000_000, F.col("_chosen")))
    else:
        result = result.withColumn("_chosen", chosen)
    return result.select(*columns, *[F.col(f"_chosen.{name}").alias(name) for name in payload])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a NULL in any of the columns: the right side of a frame-wide as-of lookup."""
    return df.dropna(how="any", subset=list(columns))


def asof_price(
    articles: DataFrame, bars: DataFrame, key: str = "symbol", time: str = "t", price: str = "close"
) -> DataFrame:
    """The close at or before each article's time."""
    priced = bars.select(key, time, price, F.lit(0).cast("bigint").alias("_id"))
    return asof_join(articles, priced, [price], "backward", None, key, time, "_id", left_repeats=True)


def asof_complete_price(
    articles: DataFrame, features: DataFrame, columns: Sequence[str], key: str = "symbol", time: str = "t"
) -> DataFrame:
    """As ``asof_price``, from bars whose feature columns are all present: late articles get an older close."""
    return asof_price(articles, complete_rows(features, columns), key, time)
