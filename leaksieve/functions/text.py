"""Text decoding and line handling with Python's string semantics, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The line boundaries of str.splitlines and the characters str.strip removes.
LINE_BOUNDARY = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: stripped lines shorter than this are not scanned.
MIN_LINE_LENGTH = 8


def decode_lenient(content: Column) -> Column:
    """UTF-8 text of a BINARY column, without its invalid bytes."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))


def decode_strict(content: Column) -> Column:
    """UTF-8 text of a BINARY column, null where it is not valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text)


def decode_base64(payload: Column) -> Column:
    """Bytes of a base64 column; characters outside the alphabet are skipped, bad padding gives null."""
    return F.try_to_binary(F.regexp_replace(payload, "[^A-Za-z0-9+/=]", ""), F.lit("base64"))


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_BOUNDARY, -1)


def strip(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITESPACE))


def long_enough(line: Column) -> Column:
    return F.length(strip(line)) >= MIN_LINE_LENGTH
