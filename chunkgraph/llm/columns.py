"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words is space, tab, line feed, vertical tab, form feed and carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """A text, null as the empty one."""
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order."""
    return F.array_remove(F.split(text, SPACES), "")


def left_by(text: Column, pattern: str) -> Column:
    """What a text has without the matches of a pattern."""
    return F.regexp_replace(text, pattern, "")


def let(value: Column, use) -> Column:
    """use(value) with the value evaluated once a row, also where a lambda within ``use`` asks for it again."""
    return F.element_at(F.transform(F.array(value), use), 1)
