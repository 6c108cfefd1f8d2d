"""Columns that need Python: one Arrow batch at a time."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.functions import similarity


def nfkc(c: Column) -> Column:
    @pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s.isascii() else unicodedata.normalize("NFKC", s))

    return of(c)


def without_accents(c: Column) -> Column:
    @pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s.isascii() else similarity.fold(s))

    return of(c)


def clean_text(c: Column, script_of: Column) -> Column:
    """NFKC; accents go if the script in column script_of is Latin."""

    @pandas_udf("string")
    def of(x: pd.Series, latin: pd.Series) -> pd.Series:
        both = (unicodedata.normalize("NFKC", s) for s in x)
        return pd.Series([similarity.fold(s) if ok and not s.isascii() else s for s, ok in zip(both, latin, strict=True)], dtype=object)

    return of(c, script_of == "latin")


def metaphones(words: Column) -> Column:
    """Distinct codes, in order, of the alphabetic words of three letters or more."""

    @pandas_udf("array<string>")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda ws: [c for c in dict.fromkeys(similarity.metaphone(w) for w in ws if len(w) >= 3 and w.isalpha()) if c])

    return of(words)


def metaphone_key(c: Column) -> Column:
    """The codes of all words of a text, space-joined."""

    @pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(lambda s: " ".join(k for k in map(similarity.metaphone, s.split()) if k))

    return of(c)


def romanized(c: Column) -> Column:
    @pandas_udf("string")
    def of(x: pd.Series) -> pd.Series:
        return x.map(similarity.romanize)

    return of(c)


SIMILARITIES = "struct<name_ratio:double,name_jaro_winkler:double,name_token_sort:double,name_token_set:double,name_partial_ratio:double,addr_partial_ratio:double>"


def string_similarities(a_name: Column, b_name: Column, a_addr: Column, b_addr: Column) -> Column:
    """All similarities of a pair that need Python, so that a pair crosses to Python once; equal pairs of a batch are compared once, partial ratios of many pairs together."""

    @pandas_udf(SIMILARITIES)
    def of(an: pd.Series, bn: pd.Series, aa: pd.Series, ba: pd.Series) -> pd.DataFrame:
        s = similarity
        names = lru_cache(maxsize=None)(lambda x, y: (s.ratio(x, y), s.jaro_winkler(x, y), s.token_sort(x, y), s.token_set(x, y)))
        distinct = list(dict.fromkeys([*zip(an, bn, strict=True), *zip(aa, ba, strict=True)]))
        partial = dict(zip(distinct, s.partial_ratios(distinct), strict=True))
        rows = [(*names(x, y), partial[x, y], partial[u, v]) for x, y, u, v in zip(an, bn, aa, ba, strict=True)]
        return pd.DataFrame(rows, columns=["name_ratio", "name_jaro_winkler", "name_token_sort", "name_token_set", "name_partial_ratio", "addr_partial_ratio"])

    return of(a_name, b_name, a_addr, b_addr)


def place(words: Column, country: Column) -> Column:
    """A struct of an address's state and city."""

    @pandas_udf("struct<state:string,city:string>")
    def of(w: pd.Series, name: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([similarity.state_and_city(list(x), c) for x, c in zip(w, name, strict=True)], columns=["state", "city"])

    return of(words, country)


def soundex(c: Column) -> Column:
    """Soundex; empty for words that don't begin with a letter."""
    return F.when(c.rlike("^[A-Za-z]"), F.soundex(c)).otherwise("")
