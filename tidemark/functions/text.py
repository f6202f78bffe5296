"""Text helpers, all built from native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE = "\x1b"
# Fixed value: the escape sequences a coloured terminal writes.
ANSI_PATTERN = "\\x1b\\[[0-9;]*m"

# White space in the Unicode sense, the four ASCII separators
# included, and the characters that end a line.
WHITESPACE = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680,
              *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
LINE_ENDS = "".join(map(chr, [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))


def strip_ansi(text: Column) -> Column:
    """Without colour codes; text without an escape is not searched at all."""
    return F.when(
        F.contains(text, F.lit(ESCAPE)), F.regexp_replace(text, ANSI_PATTERN, "")
    ).otherwise(text)


def plain_blanks(text: Column) -> Column:
    """Every white space character as a blank."""
    return F.translate(text, WHITESPACE, " " * len(WHITESPACE))


def squash_whitespace(text: Column) -> Column:
    """Every run of whitespace as one blank, none at the ends."""
    return F.trim(F.regexp_replace(plain_blanks(text), "  +", " "))


def split_lines(text: Column) -> Column:
    """Lines of a text; a two-character line end leaves an empty line between."""
    return F.split(F.translate(text, LINE_ENDS, "\n" * len(LINE_ENDS)), "\n")


def is_blank(text: Column) -> Column:
    return F.trim(plain_blanks(text)) == ""


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def first_line(text: Column, limit: int | None = None) -> Column:
    line = F.element_at(F.split(text, "\r\n|\r|\n", 2), 1)
    return line if limit is None else F.substring(line, 1, limit)


def is_offset(text: Column, allow_negative: bool = True) -> Column:
    """Does the text hold an offset? Logs may print a placeholder instead."""
    return text.rlike("^-?[0-9]+$" if allow_negative else "^[0-9]+$")
