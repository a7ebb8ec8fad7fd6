"""Path parts with the semantics of pathlib."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory_parts(path: Column) -> Column:
    """Names of the directories above a file."""
    parts = F.split(path, "/", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def suffix(name: Column) -> Column:
    """The last ``.ext`` of a file name; none for a name that only starts or ends with a dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)

