"""Rows that every operator must take: nulls, blanks, repeats, long texts and columns with the operators' own names."""

from pyspark.sql import functions as F

CLASHING = ("kept", "score", "text_key", "spans", "places", "id", "votes", "n_words", "pii_key", "component", "starts")


def documents(spark, texts, langs=None):
    rows = [(i, t, langs[i] if langs else "en") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def odd(spark):
    long = " ".join(f"w{i % 997}" for i in range(20_000))
    rows = [
        (1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "x", "en"), (5, long, "en"), (5, long, "en"), (6, long, "de"),
        (None, "some text without an id", "en"), (None, None, None), (7, "\x00 0 İ \U0001f600 <b>", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
