"""Explicit schemas of the inputs."""

from pyspark.sql import types as T

BAR_PAGE = T.StructType(
    [
        T.StructField(
            "bars",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("t", T.StringType()),
                        T.StructField("o", T.DoubleType()),
                        T.StructField("h", T.DoubleType()),
                        T.StructField("l", T.DoubleType()),
                        T.StructField("c", T.DoubleType()),
                        T.StructField("v", T.DoubleType()),
                        T.StructField("n", T.LongType()),
                        T.StructField("vw", T.DoubleType()),
                    ]
                )
            ),
        ),
        T.StructField("next_page_token", T.StringType()),
    ]
)

NEWS_PAGE = T.StructType(
    [
        T.StructField(
            "news",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("id", T.LongType()),
                        T.StructField("created_at", T.StringType()),
                        T.StructField("headline", T.StringType()),
                        T.StructField("content", T.StringType()),
                        T.StructField("symbols", T.ArrayType(T.StringType())),
                    ]
                )
            ),
        ),
        T.StructField("next_page_token", T.StringType()),
    ]
)

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("t", T.TimestampType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("v", T.DoubleType()),
        T.StructField("n", T.LongType()),
        T.StructField("vw", T.DoubleType()),
    ]
)

BAR_VALUES = ["open", "high", "low", "close", "v", "n", "vw"]

LEXICON = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("class", T.StringType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
