"""Column expressions for cleaning one comment line."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of lines that carry no comment, tested on the lower-cased line.
NOISE_MARKERS = ["id=", "|||", ">>>", "•", "●", "╭━╮"]

# Characters that separate words. White space is spelled out, because the
# short class \s stops at ASCII in Java regular expressions.
WHITE_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
FULL_SEPARATORS = "[" + WHITE_SPACE + r"""=+.!?;,/\\_。$%^*(":\-@#&|\[\]<>)]+"""
TAG_SEPARATORS = "[" + WHITE_SPACE + r"""+.!?,/_$%^*(":\-@#&)]+"""

# A phone-number-like run, an emoji with its modifiers, and a tag region.
DIGIT_RUN = r"\p{Nd}{10}"
SYMBOL = r"(\p{So}\p{Sk}*)"
TAG_REGION = r"(?s)<.*>"

# Marks put around a sentence.
START_MARK, END_MARK = "$", "!"


def is_noise(line: Column) -> Column:
    """True for lines that hold one of the noise markers."""
    lowered = F.lower(line)
    return reduce(or_, [lowered.contains(marker) for marker in NOISE_MARKERS])


def strip_tags(line: Column) -> Column:
    """Blank out everything from the first ``<`` to the last ``>``."""
    return F.regexp_replace(line, TAG_REGION, " ")


def separate_symbols(line: Column) -> Column:
    """Put blanks around every symbol so that emoji become words."""
    return F.regexp_replace(line, SYMBOL, " $1 ")


def split_words(line: Column) -> Column:
    """Words of a line whose only white space is the blank."""
    return F.split(F.trim(line), " +")


def words_full(line: Column) -> Column:
    spaced = F.regexp_replace(F.lower(line), FULL_SEPARATORS, " ")
    return split_words(separate_symbols(F.regexp_replace(spaced, DIGIT_RUN, " ")))


def words_tagged(line: Column) -> Column:
    spaced = F.regexp_replace(strip_tags(F.lower(line)), TAG_SEPARATORS, " ")
    return split_words(separate_symbols(spaced))


def drop_first_of(words: Column, marks: list[str]) -> Column:
    """Remove one word: the first occurrence of the first of ``marks`` that is present."""
    spots = [F.nullif(F.array_position(words, mark), F.lit(0)) for mark in marks]
    spot = F.coalesce(*spots, F.lit(0))
    rest = F.concat(F.slice(words, 1, (spot - 1).cast("int")), F.slice(words, (spot + 1).cast("int"), F.size(words)))
    return F.when(spot > 0, rest).otherwise(words)


def with_marks(words: Column) -> Column:
    """Sentence with its start and end mark."""
    return F.concat(F.array(F.lit(START_MARK)), words, F.array(F.lit(END_MARK)))
