"""Fields of normalised addresses, from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import arrow, lists, text


def is_alpha(t: Column) -> Column:
    return t.rlike(r"^\p{L}+$")


def last(words: Column) -> Column:
    return F.coalesce(F.get(words, F.size(words) - 1), F.lit(""))


def postal(norm: Column, country_name: Column) -> Column:
    """The last match of the country's pattern, or an empty string."""
    out = F.lit("")
    for name, pattern in lists.POSTAL.items():
        found = F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))
        out = F.when(country_name == name, text.let(found, last)).otherwise(out)
    return out


def house_number(words: Column) -> Column:
    """The first token that is a number, or two joined by a hyphen."""
    return F.coalesce(F.get(F.filter(words, lambda t: t.rlike(r"^\p{Nd}+(-\p{Nd}+)?$")), 0), F.lit(""))


def place(words: Column, country_name: Column) -> Column:
    """A struct of state and city by the country's rule; without one there is no state, and the city is the last
    alphabetic token. Rules look at tokens from the end, which expressions over arrays can't stop early at."""
    return arrow.place(words, country_name)


def state_and_city(words: Column, country_name: Column) -> tuple[Column, Column]:
    both = place(words, country_name)
    return both["state"], both["city"]


def city_after_postal(words: Column, code: Column) -> Column:
    """The alphabetic token right after the postal code."""
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: (F.get(words, i) == code) & F.coalesce(is_alpha(F.get(words, i + 1)), F.lit(False)))
    return F.when(code == "", "").otherwise(F.coalesce(F.get(words, F.get(pairs, 0) + 1), F.lit("")))
