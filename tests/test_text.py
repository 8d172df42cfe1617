import pytest
from pyspark.sql import functions as F

from citemill.functions.text import junk_ratio, keywords, normalize_text, sentences, token_count, token_pieces
from citemill.operators.sections import gate_sections, headed_sections, labelled_sections
from citemill.sources.files import html_text


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("raw, clean", [
    ("a b\x0bc　d", "a b c d"),
    ("x\nAcme Inc.2025 Form 10-K | 7\ny", "x\n\ny"),
    ("x\n  Table of Contents \ny", "x\n\ny"),
    ("x\n| 12 |\ny\n12345\nz", "x\n\ny\n12345\nz"),
    ("12 Item 1. Business", "Item 1. Business"),
    ("12 Things", "12 Things"),
    ("a\n\n\n\n\nb", "a\n\nb"),
    ("  a \n", "a"),
    ("", ""),
])
def test_normalize(spark, raw, clean):
    assert one(spark, normalize_text, raw) == clean


def test_sentences_and_tokens(spark):
    assert one(spark, sentences, "One. Two!  Three?\nFour 1.5 five") == ["One.", "Two!", "Three?", "Four 1.5 five"]
    assert one(spark, token_count, "It's 12% of naïve_x.") == 8
    pieces = one(spark, token_pieces, "a,  b\n c")
    assert pieces == ["a", ",  ", "b\n ", "c"] and "".join(pieces) == "a,  b\n c"


def test_keywords(spark):
    assert one(spark, keywords, "The U.S. don't, risk-risk  FACTORS!") == ["u", "risk", "risk", "factors"]
    assert one(spark, keywords, "the of --") == []
    assert one(spark, junk_ratio, "ab %%") == pytest.approx(0.4)


def test_headed_sections(spark):
    text = "intro Item 1. Business A Item 1A. Risk Factors B Item 7. Management C Item 9A D"
    got = {s.section: s.text for s in one(spark, headed_sections, text)}
    # The heading after Item 7 is absent, so Item 7 runs on although Item 9A follows.
    assert got == {
        "Item 1": "Item 1. Business A", "Item 1A": "Item 1A. Risk Factors B",
        "Item 7": "Item 7. Management C Item 9A D", "Item 9A": "Item 9A D",
    }
    assert one(spark, headed_sections, "nothing here") == []


def test_labelled_sections_and_gate(spark):
    df = spark.createDataFrame(
        [("f", {"Item 1": "x" * 600, "Item 1A": "y" * 40, "Item 7": "None", "Other": "z" * 99})],
        "id string, items map<string,string>",
    ).withColumn("parsed_sections", labelled_sections(F.col("items")))
    row = gate_sections(df).first()
    assert [s.section for s in row.parsed_sections] == ["Item 1", "Item 1A"]
    assert row.missing == ["Item 7"] and row.truncated == ["Item 1A"] and row.status == "failed"
    assert row.warnings == ["Item 7A", "Item 8", "Item 9A"]


def test_html_text(spark):
    page = "<p>a &amp; b</p> <script>x<1</script><!-- no --><pre>  </pre><b>c<br>d</b>\n<p>e"
    assert one(spark, lambda c: html_text(c), page) == "a & b\n \n  \nc\nd\n\n\ne"
    assert one(spark, lambda c: html_text(c), None) == ""
