"""Code lists, ordered text rules, bins and level orders as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sql(value) -> str:
    """Literal of a string, number or boolean as SQL text."""
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value).upper() if isinstance(value, bool) else repr(value)


def _literal_map(pairs: Mapping) -> Column:
    return F.expr("map(" + ", ".join(_sql(part) for part in chain.from_iterable(pairs.items())) + ")")


def recode(value: Column | str, codes: Mapping) -> Column:
    """Label of a code; NULL for a code that is not listed."""
    value = F.col(value) if isinstance(value, str) else value
    return F.try_element_at(_literal_map(codes), value)


def recode_or(value: Column | str, codes: Mapping, default: str) -> Column:
    """Label of a code; ``default`` for an unlisted code, NULL for a blank or missing one."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull() | (value == ""), F.lit(None)).otherwise(
        F.coalesce(recode(value, codes), F.lit(default))
    )


def recode_by_year(year: Column | str, value: Column | str, codes: Mapping[tuple[int, str], str]) -> Column:
    """Label of a code whose meaning depends on the year."""
    year = F.col(year) if isinstance(year, str) else year
    value = F.col(value) if isinstance(value, str) else value
    flat = {f"{y}:{code}": label for (y, code), label in codes.items()}
    return recode(F.concat(year.cast("string"), F.lit(":"), value), flat)


def classify(value: Column | str, rules: Sequence[tuple[object, Sequence[str]]], default=None) -> Column:
    """First rule with a word found anywhere in the text, ignoring case.

    With a ``default`` a missing text gets it too; without one it stays NULL.
    """
    value = F.col(value) if isinstance(value, str) else value
    result = None
    for label, words in rules:
        found = value.rlike("(?i)" + "|".join(re.escape(w).replace("\\ ", " ") for w in words))
        result = F.when(found, F.lit(label)) if result is None else result.when(found, F.lit(label))
    return result.otherwise(F.lit(default)) if default is not None else result


def bin_by(column: str, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open interval below each break, the last one open at the top."""
    if len(labels) != len(breaks) + 1:
        raise ValueError("one more label than breaks is needed")
    below = [f"WHEN {column} < {limit} THEN {_sql(label)}" for limit, label in zip(breaks, labels)]
    return F.expr(f"CASE {' '.join(below)} WHEN {column} >= {breaks[-1]} THEN {_sql(labels[-1])} END")


def level_of(value: Column | str, levels: Sequence[str]) -> Column:
    """Position of a label in its level order, from 1; NULL if it is not a level."""
    return recode(value, {label: i for i, label in enumerate(levels, start=1)})


def pair_label(first: Column | str, second: Column | str, labels: Mapping[tuple[str, str], str]) -> Column:
    """Label of a pair of categories; NULL for a pair that is not listed."""
    first = F.col(first) if isinstance(first, str) else first
    second = F.col(second) if isinstance(second, str) else second
    flat = {f"{a}\t{b}": label for (a, b), label in labels.items()}
    return recode(F.concat(first, F.lit("\t"), second), flat)


def title_case(value: Column | str) -> Column:
    """Upper-case the first letter of every word, where hyphens and brackets also end a word.

    ``initcap`` ends words at blanks only, so a marked blank is put behind the
    other word ends and taken out again.
    """
    value = F.col(value) if isinstance(value, str) else value
    mark = "\u0001 "
    for end in "-/(,&":
        value = F.replace(value, F.lit(end), F.lit(end + mark))
    return F.replace(F.initcap(value), F.lit(mark), F.lit(""))


def drop_suffix(value: Column | str, length: int) -> Column:
    """Text without its last ``length`` characters."""
    value = F.col(value) if isinstance(value, str) else value
    return F.substr(value, F.lit(1), F.greatest(F.length(value) - F.lit(length), F.lit(0)))
