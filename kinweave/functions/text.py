"""Text columns from built-in functions; all take and give columns, empty strings stand for missing values."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinweave.functions import lists


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once and standing in the plan once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def filled(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def lookup(table: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def literal_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def source_of(entity_id: Column) -> Column:
    """S1, S2 or S3 by the id's prefix, else UNKNOWN."""
    head = F.substring(entity_id, 1, 3)
    return F.when(head.isin("S1-", "S2-", "S3-"), F.substring(entity_id, 1, 2)).otherwise("UNKNOWN")


def country(c: Column) -> Column:
    """Canonical country; names without an alias pass through in lower case."""
    low = F.lower(F.trim(filled(c)))
    return F.coalesce(lookup(lists.COUNTRY)[low], low)


def bucket(c: Column) -> Column:
    """The blocking bucket: canonical country, `other` if there is none."""
    name = country(c)
    return F.when(name == "", "other").otherwise(name)


def punctuation(c: Column) -> Column:
    """& becomes `and`; whatever isn't a letter, number, mark or space becomes a space; spaces are collapsed."""
    spaced = F.regexp_replace(F.replace(c, F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}\p{M}\s]", " ")
    return F.trim(F.regexp_replace(spaced, r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def digit_runs(c: Column) -> Column:
    """Distinct runs of digits, as first seen."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1)))


def script(c: Column) -> Column:
    """The script of the first Indic character, else latin, else other."""
    first = F.regexp_extract(c, r"([ऀ-ॿ஀-௿ఀ-೿])", 1)
    code = F.when(first == "", -1)
    for name in ("devanagari", "tamil", "telugu", "kannada"):
        low = lists.INDIC_BLOCKS[name]
        code = code.when(first.rlike(f"[\\u{low:04X}-\\u{low + 127:04X}]"), low)
    found = lookup({str(lists.INDIC_BLOCKS[n]): n for n in ("devanagari", "tamil", "telugu", "kannada")})[code.cast("string")]
    return F.coalesce(found, F.when(c.rlike(r"[A-ɏ]"), "latin").otherwise("other"))


def _replaced(words: Column, table: Column) -> Column:
    return F.transform(words, lambda t: F.coalesce(table[t], t))


def expand(words: Column, country_name: Column) -> Column:
    """Tokens with the country's abbreviations written out, as single words again."""
    out = words
    for name, table in lists.ABBREVIATIONS.items():
        out = F.when(country_name == name, _replaced(words, lookup(table))).otherwise(out)
    return tokens(F.array_join(out, " "))


def tail(words: Column, k: int) -> Column:
    """The last k words, joined; null if there are fewer."""
    return F.when(F.size(words) >= k, F.array_join(F.slice(words, F.greatest(F.size(words) - (k - 1), F.lit(1)), k), " "))


def longest_tail(words: Column, names: Iterable[str], most: int) -> Column:
    """The longest tail of up to `most` words that is one of names, or an empty string."""
    known = literal_array(names)
    tails = F.array(*[tail(words, k) for k in range(most, 0, -1)])
    return F.coalesce(F.get(F.filter(tails, lambda x: F.array_contains(known, x)), 0), F.lit(""))


def legal_suffix(words: Column, country_name: Column) -> Column:
    """The longest tail of five words or fewer that is a legal form of the country, or an empty string."""
    out = F.lit("")
    for name, forms in lists.LEGAL_SUFFIXES.items():
        out = F.when(country_name == name, longest_tail(words, forms, 5)).otherwise(out)
    return out


def without_suffix(words: Column, suffix: Column) -> Column:
    n = F.when(suffix == "", 0).otherwise(F.size(F.split(suffix, " ")))
    return F.slice(words, 1, F.size(words) - n)


def without_stopwords(words: Column) -> Column:
    """Words that aren't stopwords; all of them if none is left."""
    kept = F.filter(words, lambda t: ~t.isin(*lists.STOPWORDS))
    return F.when(F.size(kept) == 0, words).otherwise(kept)


def word_terms(c: Column) -> Column:
    """Runs of two or more word characters, lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def char_terms(c: Column, least: int = 2, most: int = 4) -> Column:
    """Character n-grams of each word padded by a space on both sides; a word shorter than n has none of that n."""
    padded = F.transform(tokens(F.lower(c)), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def run_of(w: Column, n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - (n - 1), F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))

    def grams(w: Column) -> Column:
        parts = []
        for n in range(least, most + 1):
            run = run_of(w, n)
            parts.append(run if n == least else F.when(F.length(w) >= n, run).otherwise(F.array().cast("array<string>")))
        return F.concat(*parts)

    return F.flatten(F.transform(padded, grams))


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct character n-grams; the whole string if it has n characters or fewer, none if it is empty."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (n - 1), F.lit(1))), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(c == "", F.array().cast("array<string>")).when(F.length(c) <= n, F.array(c)).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def length_bucket(n: Column) -> Column:
    return F.when(n == 0, "0").when(n <= 10, "1-10").when(n <= 20, "11-20").when(n <= 40, "21-40").otherwise("41+")


def source_mix(ids: Column) -> Column:
    """Which of S2 and S3 an id list draws on."""
    s2, s3 = F.exists(ids, lambda x: x.startswith("S2-")), F.exists(ids, lambda x: x.startswith("S3-"))
    return F.when(s2 & s3, "s2+s3").when(s2, "s2").when(s3, "s3").otherwise("none")


def retrieval_text(core: Column, address: Column, include_address: bool) -> Column:
    return F.trim(F.concat_ws(" ", core, address)) if include_address else core


def embedding_text(role: str, name: Column, address: Column) -> Column:
    """`query: ` or `passage: ` with the name and, if there is one, the address."""
    return F.concat(F.lit(f"{role}: "), name, F.when(address == "", "").otherwise(F.concat(F.lit(" | "), address)))


def profile_script(c: Column) -> Column:
    """For profiles: which of Latin, Indic and other letters a text has."""
    latin, indic = c.rlike(r"[A-Za-z\u00C0-\u024F]"), c.rlike(r"[\u0900-\u0D7F]")
    return F.when(latin & indic, "mixed").when(indic, "indic").when(latin, "latin").when(c == "", "empty").otherwise("other")


def profile_suffix(c: Column) -> Column:
    """For profiles: the last word in lower case without punctuation."""
    return F.regexp_extract(F.lower(c), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)


def mild(c: Column) -> Column:
    """For leak probes: lower case, single spaces, nothing else."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
