"""String functions with the semantics of Java's ``String.split``."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def java_split(line: Column, separator: str = " ") -> Column:
    """Split on a literal separator; empty strings at the end are dropped.

    An empty line gives one empty string; a line of separators alone gives an empty array.
    """
    sep = "(?:" + re.escape(separator) + ")"
    trimmed = F.rtrim(line, F.lit(separator)) if len(separator) == 1 else F.regexp_replace(line, sep + "+$", "")
    return F.when(line == "", F.array(F.lit(""))).when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, sep))


def java_split_local(line: str, separator: str = " ") -> list[str]:
    """The same for a Python string."""
    if not line:
        return [""]
    parts = line.split(separator)
    while parts and not parts[-1]:
        parts.pop()
    return parts


def key_value_line(key: Column, value: Column, separator: str = ": ") -> Column:
    """``key: value``, as the text sinks write it."""
    return F.concat(key.cast("string"), F.lit(separator), value.cast("string"))
