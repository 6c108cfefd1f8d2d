"""Token counts of whole texts under a lower-casing word BPE, with a shortcut for whole-token words.

Offline, every vocabulary string that ends a word is merged by the tokenizer's own rules; those that end as one token
are proven. A text is split into special strings and words; a proven word counts one, only the rest are merged.

Defined cases: a null text is empty and has no tokens; a special string inside a text is one token; repeated rows give
repeated rows, and doc_id is never read; a text of any length is counted whole; an empty table gives an empty result;
other columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from tokenizers import Tokenizer

from kinweave.llm.common import prepare, text_or_empty

#: Texts of these characters are normalised here, which is faster; others by the library, whose Unicode tables are its own.
LATIN = re.compile("[\x00-\u024f]*")
#: Words that a Python worker remembers, each of at most KEEP_CHARS characters.
KEPT_WORDS, KEEP_CHARS = 600_000, 48


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(other)}


class Words(dict):
    """Tokens of each word, merged when first seen."""

    def __init__(self, model, whole: frozenset[str]) -> None:
        super().__init__()
        self.model, self.whole = model, whole
        self.to_chars = byte_alphabet()

    def __missing__(self, word: str) -> int:
        if word in self.whole:
            n = 1
        else:
            n = len(self.model.tokenize(word.encode().decode("latin-1").translate(self.to_chars)))
        if len(word) <= KEEP_CHARS:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = n
        return n


class Counter:
    """Counts as the library does: special strings first, then NFC, lower case, words, bytes and merges."""

    def __init__(self, path: str, whole: frozenset[str] = frozenset()) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        if [x["type"] for x in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in steps] != ["Split", "ByteLevel"]:
            raise ValueError("only lower-casing word BPE files are handled")
        self.ending = spec["model"]["end_of_word_suffix"]
        self.vocabulary = spec["model"]["vocab"]
        self.split = regex.compile(steps[0]["pattern"]["Regex"])
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.replaced = [(regex.compile(x["pattern"].get("Regex") or regex.escape(x["pattern"]["String"])), x["content"].replace("\\", r"\\")) for x in spec["normalizer"]["normalizers"] if x["type"] == "Replace"]
        library = Tokenizer.from_file(path)
        self.normalise, self.words = library.normalizer.normalize_str, Words(library.model, whole)

    def prove(self) -> frozenset[str]:
        """The words whose merges end in one token: vocabulary strings with a word's ending, each merged once."""
        back = {c: b for b, c in byte_alphabet().items()}
        proven = set()
        for entry in self.vocabulary:
            if entry.endswith(self.ending) and (stem := entry.removesuffix(self.ending)):
                try:
                    word = bytes(back[c] for c in stem).decode()
                except (KeyError, UnicodeDecodeError):
                    continue
                if len(self.words.model.tokenize(stem)) == 1:
                    proven.add(word)
        return frozenset(proven)

    def _plain(self, text: str) -> int:
        if LATIN.fullmatch(text):
            low = unicodedata.normalize("NFC", text)
            for old, new in self.replaced:
                low = old.sub(new, low)
            low = low.lower()
        else:
            low = self.normalise(text)
        return sum(map(self.words.__getitem__, self.split.findall(low)))

    def count(self, text: str) -> int:
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))


@lru_cache(maxsize=2)
def prove_whole_tokens(path: str) -> frozenset[str]:
    return Counter(path).prove()


_counters: dict[str, Counter] = {}


def n_tokens_column(df: DataFrame, path: str, text: str = "text") -> Column:
    """Tokens of each text. The proven words are broadcast: never more than the vocabulary's entries."""
    proven = df.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))

    @pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if path not in _counters:
            _counters[path] = Counter(path, proven.value)
        of = _counters[path].count
        for batch in batches:
            yield pd.Series([of(t) for t in batch], dtype="int64")

    return count(text_or_empty(text))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit."""
    prepare(docs.sparkSession)
    out = docs.withColumn("n_bytes", F.octet_length(text_or_empty(text)).cast("long")).withColumn("n_tokens", n_tokens_column(docs, path, text))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
