"""Costly expressions evaluated once although rows are filtered by them.

A filter on a computed column moves below the projection and is then evaluated a second time. Here the
values become one struct in a one-element array; rows that fail give an empty array.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_where(df: DataFrame, cols: dict[str, Column], keep: Callable[[Column], Column],
               derive: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """``df`` with ``cols`` (and what ``derive`` makes of them), only rows for which ``keep`` holds.

    ``derive`` and ``keep`` get the struct of values; with ``derive`` only its columns are added.
    """
    rows = F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))
    if derive is not None:
        rows = F.transform(rows, lambda s: F.struct(*[c.alias(n) for n, c in derive(s).items()]))
    hit = F.filter(rows, keep)
    # The outer form adds no filter on the array before the generator, which would compute it again.
    return df.withColumn("_r", F.explode_outer(hit)).where("_r is not null").select(*df.columns, "_r.*")


def explode_kept(df: DataFrame, name: str, items: Column) -> DataFrame:
    """One row per array element, none for an empty array, with the array computed once."""
    return df.withColumn(name, F.explode_outer(items)).where(F.col(name).isNotNull())


def required_words(regex: str) -> tuple[str, ...]:
    """Words any match must contain (lower case). Patterns with groups, choices or classes give none."""
    body = regex.removeprefix("(?i)")
    body = re.sub(r"\\[()*.\\$]", " ", body)           # escaped signs are literals but not words
    body = re.sub(r"\\[swdb][+*]?(\{\d+,?\d*\})?", " ", body)
    body = body.replace(".*", " ")
    if re.search(r"[|()\[\]?*+{}\\]", body):
        return ()
    return tuple(dict.fromkeys(w for w in re.findall(r"[a-z_]{3,}", body.lower())))


def guarded(content: Column, lowered: Column, regex: str) -> Column:
    """``content.rlike(regex)`` behind cheap tests for the words every match needs."""
    cond = None
    for w in required_words(regex):
        cond = lowered.contains(w) if cond is None else cond & lowered.contains(w)
    return content.rlike(regex) if cond is None else cond & content.rlike(regex)
