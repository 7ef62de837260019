"""Text expressions. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narracode.spec import NULL_TOKENS

# Letters, digits and underscore of any script; combining marks are not word characters.
WORD = r"[\p{L}\p{N}_]+"
WORD_2 = r"[\p{L}\p{N}_]{2,}"


def repair_sentence_gaps(text: Column) -> Column:
    """Put the missing blank back between a full stop and the next letter."""
    return F.regexp_replace(text, r"\.([a-zA-Z])", ". $1")


# White space of any script, and the four separators from U+001C to U+001F.
SPACE = r"[\s\x1C-\x1F]"
# Line ends: those of any script, and the separators of files, groups and records.
LINE_END = r"\R|[\x1C-\x1E]"


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+$", "")


def nonempty_lines(text: Column) -> Column:
    return F.filter(F.split(text, LINE_END), lambda line: line != "")


def last_field(line: Column, sep: str = ":") -> Column:
    return F.element_at(F.split(line, sep), -1)


def after_prefix(text: Column, prefix: Column) -> Column:
    return F.substring(text, F.length(prefix) + 1, F.length(text))


def contains_word(text: Column, word: str) -> Column:
    """Case-free substring test."""
    return F.contains(F.lower(text), F.lit(word))


def record_length(le: Column, cme: Column) -> Column:
    return F.length(le) + F.length(cme)


def numbered_key(prefix: str, number: Column) -> Column:
    """``<prefix>07`` style keys."""
    return F.format_string(prefix + "%02d", number)


def tokens_to_null(text: Column) -> Column:
    """Map the spellings of a missing value to null; Spark's reader keeps them as text."""
    return F.when(~text.isin(NULL_TOKENS), text)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased tokens of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_2), F.lit(0))
