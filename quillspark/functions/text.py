"""Column helpers for text and patterns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it; also keeps plans from growing."""
    return F.transform(F.array(value), f)[0]


def rx(pattern: str, flags: str = "") -> str:
    """A pattern with Unicode classes, as the data model defines them."""
    return f"(?U{flags}){pattern}"


def folded(text: Column) -> Column:
    """Lower case after upper case: holds every ASCII string that the text holds in any case."""
    return F.lower(F.upper(text))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null without a match or with an empty group."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def quote(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def literal(text: Column) -> Column:
    """A text as a quoted literal on one line, whatever it holds: single quotes, or double ones where it has single ones
    only; backslashes, the quote and characters that do not print are escaped; null is ``None``."""
    code = lambda c: F.ascii(c)  # noqa: E731  the code point of the first character
    escape = lambda c: F.when(code(c) < 256, F.format_string("\\x%02x", code(c))).otherwise(
        F.when(code(c) < 65536, F.format_string("\\u%04x", code(c))).otherwise(F.format_string("\\U%08x", code(c)))
    )
    hidden = lambda c: c.rlike(r"[\p{C}\p{Z}]") & (c != " ")
    known = lambda c: F.when(c == "\n", F.lit("\\n")).when(c == "\r", F.lit("\\r")).when(c == "\t", F.lit("\\t"))
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    shown = F.when(
        plain.rlike(r"[\p{C}\p{Z}&&[^ ]]"), F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(known(c), F.when(hidden(c), escape(c)), c)), "")
    ).otherwise(plain)
    single, double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    quoted = F.when(single & ~double, F.concat(F.lit('"'), shown, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(shown, F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.coalesce(quoted, F.lit("None"))


def blank(text: Column) -> Column:
    """Whether a text is null or empty: what counts as missing."""
    return F.coalesce(text, F.lit("")) == ""


def given(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*$", 0)


def stem(name: Column) -> Column:
    """A file name without its last suffix; a name that only starts with a dot has none."""
    return F.regexp_replace(name, r"(?<=[^/])\.[^./]+$", "")


def suffix(name: Column) -> Column:
    return F.regexp_extract(name, r"(?<=[^/])\.[^./]+$", 0)


def control_free(text: Column) -> Column:
    """Without control characters but tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def confidence(text: Column) -> Column:
    """How much text there is, saturating at 5000 characters."""
    return F.least(F.length(F.coalesce(text, F.lit(""))) / F.lit(5000.0), F.lit(1.0))


def text_hash(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")))
