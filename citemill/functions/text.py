"""Text cleaning, sentence and token expressions. All run inside the JVM."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from citemill.functions.stopwords import EFFECTIVE_STOPWORDS

# Every character Python's str.isspace() accepts, tab and newline last.
ODD_SPACES = (
    "\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACES = ODD_SPACES + "\t\n"
# The same characters inside a class of a regular expression; ranges are tested much faster than a list of them.
GAPS = r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Page furniture of annual filings, as regular expressions.
PAGE_HEADER = r"(?imu)^.{0,60}?20\p{Nd}\p{Nd}\s+form\s+10-?k.*$"
CONTENTS_LINE = r"(?imu)^[ \t]*table of contents[ \t]*$"
PAGE_NUMBER_LINE = r"(?m)^[ \t]*\|?[ \t]*\p{Nd}{1,4}[ \t]*\|?[ \t]*$"
LEADING_PAGE_NUMBER = r"(?iu)\A\s*\p{Nd}{1,4}\s+(?=item\s)"

SENTENCE_GAP = rf"(?<=[.!?])[{GAPS}]+"
# A token is a run of word characters or one other visible character. A piece
# is a token with the space after it, so that pieces join back to the text.
TOKEN_PIECE = rf"(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{GAPS}])[{GAPS}]*"

# What stands between words: white space and ASCII punctuation.
WORD_GAP = "[" + "".join("\\" + c for c in string.punctuation) + GAPS + "]+"


def strip(text: Column) -> Column:
    """Drop leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(SPACES))


def normalize_text(text: Column) -> Column:
    """Plain spaces, no page furniture, at most one blank line in a row."""
    out = F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))
    for pattern in (PAGE_HEADER, CONTENTS_LINE, PAGE_NUMBER_LINE, LEADING_PAGE_NUMBER):
        out = F.regexp_replace(out, pattern, "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Sentences of a text: cut at white space after a full stop, ``!`` or ``?``."""
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: strip(s) != "")


def token_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PIECE), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(token_pieces(text))


def words(text: Column) -> Column:
    """Lower-case words between white space and ASCII punctuation, stopwords kept. Empty strings may stand at the ends."""
    return F.split(F.lower(text), WORD_GAP)


def is_keyword(word: Column) -> Column:
    return (word != "") & ~word.isin(EFFECTIVE_STOPWORDS)


def keywords(text: Column) -> Column:
    """Words that count for keyword search, in order and with repeats."""
    return F.filter(words(text), is_keyword)


def junk_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space."""
    junk = F.regexp_replace(text, rf"[\p{{L}}\p{{N}}{GAPS}]+", "")
    return F.try_divide(F.length(junk).cast("double"), F.length(text).cast("double"))


def has_upper(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{Lu}"))
