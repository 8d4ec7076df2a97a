"""SQL functions: normalize_text, encode_phonetic, phonetic_similarity, phonetic_contains, and the table function extract_slots."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyvox.functions import phonetic
from tallyvox.functions.plain import normalised
from tallyvox.operators.slots import Extractor
from tallyvox.settings import Settings
from tallyvox.shipping import Sent


def register(spark: SparkSession, settings: Settings | None = None) -> None:
    """Register all of them in a session; they take normalised texts, but for normalize_text."""
    settings = settings or Settings()
    encoder = Sent(spark, phonetic.encoder_for(spark))
    extractor = Sent(spark, Extractor(normalised, settings.assets))

    @F.pandas_udf("array<string>")
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else encoder.value.readable(t))

    def pairwise(measure):
        @F.pandas_udf("double")
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            e = encoder.value.encode
            return pd.Series([None if x is None or y is None else measure(e(x), e(y)) for x, y in zip(a, b)], dtype="float64")

        return run

    class Slots:
        def eval(self, text: str):
            for s in extractor.value.extract(text) if text is not None else []:
                yield s

    @F.pandas_udf("string")
    def normalize(texts: pd.Series) -> pd.Series:
        return texts.map(normalised)

    spark.udf.register("normalize_text", normalize)
    spark.udf.register("encode_phonetic", encode)
    spark.udf.register("phonetic_similarity", pairwise(phonetic.similarity))
    spark.udf.register("phonetic_contains", pairwise(phonetic.containment))
    spark.udtf.register("extract_slots", F.udtf(Slots, returnType="name string, value string, grp string, start int, end int"))
