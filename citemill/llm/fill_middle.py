"""Fill-in-the-middle forms of texts, cut by one counted pattern for each row.

``regexp_count`` gives the number of tokens. Two places between tokens are drawn from a hash of the doc_id, and a
pattern made for the row, with possessive groups of exactly a and b - a tokens, takes prefix, middle and suffix in one
match; its replacement writes them in the order of the form. A possessive counted group never gives tokens back, so
Java walks it in a loop and long texts need no deep stack. All is column expressions on one row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# What a match is replaced by, and how a form is taken apart again. A text with a mark in it stays plain, and no mark
# can begin or end with a part of another one, so the first mark of each kind is the written one.
WRITTEN = {"psm": "<P>$1<S>$3<M>$2", "spm": "<S>$3<P>$1<M>$2"}
READ = {"psm": (r"(?s)\A<P>(.*?)<S>(.*?)<M>(.*)\z", "$1$3$2"), "spm": (r"(?s)\A<S>(.*?)<P>(.*?)<M>(.*)\z", "$2$3$1")}


def _draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hash of the seed and the key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text a form was made of."""
    read = lambda name: F.regexp_replace(output, F.lit(READ[name][0]), F.lit(READ[name][1]))
    return F.when(form == "psm", read("psm")).when(form == "spm", read("spm")).otherwise(output)


def fill_in_middle(docs: DataFrame, fim_percent: int = 50, spm_percent: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, output, prefix_chars, middle_chars) for each row of ``docs`` (doc_id, text; other columns are
    not read).

    ``n`` counts the tokens, a token being a word with the white space before it, or the white space that ends the
    text. A null text is empty. An empty text, one with ``<P>``, ``<S>`` or ``<M>`` in it and all but ``fim_percent``
    of 100 others are plain: the text itself, the counts null. A row without doc_id draws by the seed alone. Rows that
    repeat a doc_id draw alike. Where both places are equal, the middle is empty.
    """
    drawn = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(_draws(F.col("doc_id"), seed), 1)]
    ).withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    first, second = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= fim_percent)
    cut = drawn.select(
        "doc_id", "text", "n", F.least(first, second).alias("a"), F.greatest(first, second).alias("b"),
        F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"),
    )
    pattern = F.format_string(rf"(?s)\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*)\z", F.col("a"), F.col("b") - F.col("a"))
    template = F.when(F.col("form") == "spm", WRITTEN["spm"]).otherwise(WRITTEN["psm"])
    made = cut.select(
        "doc_id", "n", "form",
        F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, template)).alias("output"),
    )
    at = lambda mark: F.instr("output", mark)
    prefix = F.when(F.col("form") == "psm", at(SUFFIX) - 4).when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX) - 3)
    middle = F.when(F.col("form") != "plain", F.length("output") - at(MIDDLE) - 2)
    return made.select(
        "doc_id", "n", "form", "output", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars")
    )


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of the outputs and of the texts rebuilt from them in place of the outputs."""
    sha = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return fill_in_middle(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
