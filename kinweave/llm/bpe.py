"""Byte-level BPE encoding and decoding by DuckDB inside each partition.

Encoding: the distinct words of a batch become rows (word, position, token) of single bytes. A recursive query joins
neighbouring tokens with the table of merges and contracts each word's leftmost pair of least rank until no pair is
left. A word that is a token as a whole is that token, as in the library. Decoding: rows (position, token) of a batch join the
vocabulary, an ordered aggregation lines up their bytes, and the texts' numbers of tokens cut them apart.

Words beyond LONG_WORD bytes would make the recursive query's rows grow with the square of their length; the same
merges are then made in a heap. Results are the same.

Texts split as in the library, whose Unicode tables may be of another version than those here.

Defined cases: a null text is empty; an empty text has no ids and decodes to no bytes; an empty table gives an empty
result; repeated rows give repeated rows; texts of any length are encoded whole; tokens not in the vocabulary raise an
error; other columns are kept, columns named like the outputs are replaced. Batches hold few rows, and the cache of encoded words is bounded.
"""

from __future__ import annotations

import base64
import heapq
import re
import tempfile
from collections.abc import Iterator
from functools import lru_cache

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import fresh, prepare, text_or_empty

LONG_WORD = 256
#: Encoded words that a Python worker keeps in each of two generations, each of at most KEEP_CHARS characters.
KEPT_WORDS, KEEP_CHARS = 300_000, 32
#: Characters of texts whose new words one recursive query takes together, unless a single batch has more.
GATHER_CHARS = 1_000_000
#: Bytes of words, or tokens, in one query at most, unless a single word has more: what a query holds doesn't grow with a text.
ROWS = 200_000

#: A token has its place p, the next token's place and the next token; next is -1 and following null at a word's end.
#: Each step finds the pairs' ranks, the best pair of each word, and what follows the token that the best pair absorbs.
CONTRACT = """
WITH RECURSIVE state(w, p, next, t, following, done) AS (
  SELECT w, p, next, t, following, false FROM words
  UNION ALL (
    WITH pairs AS MATERIALIZED (
      SELECT w, p, next, t, following, (merges.rank::BIGINT << 16) + p AS key
      FROM state LEFT JOIN merges ON merges.ab = (t::BIGINT << 32) + following
      WHERE NOT done
    ), best AS MATERIALIZED (
      SELECT w, min(key) AS key, (min(key) & 65535)::INTEGER AS p, (min(key) >> 16)::INTEGER AS rank, arg_min(next, key) AS absorbed FROM pairs GROUP BY w
    ), gone AS MATERIALIZED (
      SELECT pairs.w, pairs.next, pairs.following FROM pairs JOIN best ON best.w = pairs.w AND best.absorbed = pairs.p
    )
    SELECT pairs.w, pairs.p,
      CASE WHEN pairs.p = best.p THEN gone.next ELSE pairs.next END,
      CASE WHEN pairs.p = best.p THEN best.rank ELSE pairs.t END,
      CASE WHEN pairs.p = best.p THEN gone.following WHEN pairs.next = best.p THEN best.rank ELSE pairs.following END,
      best.key IS NULL
    FROM pairs JOIN best ON best.w = pairs.w LEFT JOIN gone ON gone.w = pairs.w
    WHERE best.key IS NULL OR pairs.p <> best.absorbed
  )
)
SELECT w, list(t ORDER BY p) AS ids FROM state WHERE done GROUP BY w ORDER BY w
"""
JOIN_UP = "SELECT list(bytes ORDER BY p) AS parts FROM tokens JOIN vocabulary USING (t)"
#: Texts of these characters alone split alike by Python's own expressions, which are faster: here letters are all word
#: characters but digits and _, and numbers are decimal digits.
PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ſ]*")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for PLAIN texts, if all its character classes have a plain form."""
    for name, own in ((r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"), (r"\p{L}", r"[^\W\d_]"), (r"\p{N}", r"\d")):
        pattern = pattern.replace(name, own)
    return None if r"\p" in pattern else re.compile(pattern)


def _ranges(chars: set[str]) -> str:
    """The characters as ranges for a set in a pattern."""
    codes = np.array(sorted(map(ord, chars)))
    cuts = np.flatnonzero(np.diff(codes) > 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(codes[[0, *(cuts + 1)]].tolist(), codes[[*cuts, -1]].tolist(), strict=True)) if len(codes) else ""


@lru_cache(maxsize=4)
def as_library(pattern: str) -> tuple[str, str]:
    """The characters that are letters or numbers either here or in the library alone, and the pattern with the library's own.

    The two know different versions of Unicode. The library is asked once about every character.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    odd: set[str] = set()
    for name in (r"\p{L}", r"\p{N}"):
        if name in pattern:
            own = tiktoken.Encoding(name, pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            theirs = set(own.decode(own.encode_ordinary(every)))
            odd |= theirs ^ set(regex.findall(name, every))
            held = _ranges(theirs)
            pattern = regex.sub(r"\[[^\]]*\]", lambda m: m[0].replace(name, held), pattern).replace(name, f"[{held}]")  # noqa: B023
    return _ranges(odd), pattern


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Coder:
    """Encodes and decodes batches of texts by a file of ranks."""

    def __init__(self, path: str, pattern: str, library: tuple[str, str] | None = None) -> None:
        odd, exact = library or as_library(pattern)
        self.ranks, self.split, self.split_plain, self.split_exact = read_ranks(path), regex.compile(pattern), plain_pattern(pattern), regex.compile(exact)
        self.odd = re.compile(f"[{odd}]") if odd else None
        self.spill = tempfile.TemporaryDirectory(prefix="kinweave-bpe-")  # of this process alone, gone with it
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.single = np.array([self.ranks[bytes([x])] for x in range(256)], np.int64)
        rows = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "150MB", "temp_directory": self.spill.name})
        self.db.execute("SET allocator_flush_threshold = '1MB'; SET allocator_bulk_deallocation_flush_threshold = '1MB'")  # memory goes back between queries
        self._table("m", {"ab": pa.array([x[0] for x in rows], pa.int64()), "rank": pa.array([x[1] for x in rows], pa.int32())}, "merges")
        self._table("v", {"t": pa.array(list(self.ranks.values()), pa.int32()), "bytes": pa.array(list(self.ranks), pa.binary())}, "vocabulary")

    def _table(self, name: str, columns: dict, to: str) -> None:
        self.db.register(name, pa.table(columns))
        self.db.execute(f"CREATE TABLE {to} AS SELECT * FROM {name}")
        self.db.unregister(name)

    def _query(self, name: str, columns: dict, sql: str) -> pa.Table:
        self.db.register(name, pa.table(columns))
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def _long(self, word: bytes) -> list[int]:
        """The same merges as CONTRACT makes, by a heap of (rank, position)."""
        token, ranks, n = [bytes([x]) for x in word], self.ranks, len(word)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := token[i] + token[i + 1]) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            if token[i] is None or (j := after[i]) < 0 or token[i] + token[j] != pair:
                continue
            token[i], token[j], after[i] = pair, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] >= 0 and (p := token[x] + token[after[x]]) in ranks:
                    heapq.heappush(heap, (ranks[p], x, p))
        return [ranks[t] for t in token if t is not None]

    def words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word as little-endian unsigned 32-bit integers."""
        out, rest, data = {}, [], []
        for word in words:
            b = word.encode()
            if b in self.ranks:
                out[word] = self.ranks[b].to_bytes(4, "little")
            elif len(b) > LONG_WORD:
                out[word] = np.array(self._long(b), "<u4").tobytes()
            else:
                rest.append(word)
                data.append(b)
        sizes = np.cumsum([0, *map(len, data)])
        cuts = [0, *(np.flatnonzero(np.diff(sizes[:-1] // ROWS)) + 1).tolist(), len(rest)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                self._contract(rest[a:b], data[a:b], out)
        return out

    def _contract(self, words: list[str], data: list[bytes], out: dict[str, bytes]) -> None:
        lengths = np.fromiter(map(len, data), np.int64, len(data))
        raw = np.frombuffer(b"".join(data), np.uint8)
        place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        token, last = self.single[raw], np.zeros(len(raw), bool)
        last[np.cumsum(lengths) - 1] = True
        columns = {"w": np.repeat(np.arange(len(words)), lengths), "p": place, "next": np.where(last, -1, place + 1), "t": token}
        narrow = {k: pa.array(x.astype(np.int32)) for k, x in columns.items()}
        found = self._query("words", narrow | {"following": pa.array(np.append(token[1:], 0).astype(np.int32), mask=last)}, CONTRACT)
        ids = found["ids"].combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), (np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy()))) * 4).tolist()
        for k, word in enumerate(words):
            out[word] = flat[ends[k] : ends[k + 1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        seen: dict[str, str] = {}
        pieces = []
        for text in texts:
            plain = self.split_plain and PLAIN.fullmatch(text)
            found = (self.split_plain if plain else self.split_exact if self.odd and self.odd.search(text) else self.split).findall(text)
            pieces.append(list(map(seen.setdefault, found, found)))  # one object for each distinct word
        kept, older = self.kept, self.older
        look, again, new = {}, {}, []
        for w in seen:
            if (x := kept.get(w)) is not None:
                look[w] = x
            elif (x := older.get(w)) is not None:
                again[w] = x
            else:
                new.append(w)
        again |= self.words(new)
        look |= again
        if len(kept) + len(again) > KEPT_WORDS:
            self.older, self.kept = kept, {}
        self.kept.update((w, x) for w, x in again.items() if len(w) <= KEEP_CHARS)
        return [b"".join(map(look.__getitem__, words)) for words in pieces]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        data, at = zip(*(self._join_up(flat[i : i + ROWS]) for i in range(0, max(1, len(flat)), ROWS)), strict=True)
        begins = np.concatenate([a[:-1] + n for a, n in zip(at, np.cumsum([0, *map(len, data)]).tolist(), strict=False)] + [[sum(map(len, data))]])
        whole, ends = memoryview(b"".join(data)), begins[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        return [bytes(whole[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def _join_up(self, tokens: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of the tokens, and where each begins and the last ends."""
        if not len(tokens):
            return b"", np.zeros(1, np.int64)
        parts = self._query("tokens", {"p": np.arange(len(tokens), dtype=np.int32), "t": tokens}, JOIN_UP)["parts"].combine_chunks()
        values = parts.flatten().cast(pa.large_binary())
        if len(values) != len(tokens):
            raise ValueError("a token is not in the vocabulary")
        at = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
        return bytes(memoryview(values.buffers()[2])[at[0] : at[-1]]), at - at[0]


@lru_cache(maxsize=2)
def coder(path: str, pattern: str, library: tuple[str, str]) -> Coder:
    return Coder(path, pattern, library)


def encode_column(path: str, pattern: str, text: str = "text") -> Column:
    """The ids of a text as little-endian unsigned 32-bit integers."""
    library = as_library(pattern)

    @pandas_udf("binary")
    def encode(batch: pd.Series) -> pd.Series:
        return pd.Series(coder(path, pattern, library).encode(batch.tolist()), dtype=object)

    return encode(text_or_empty(text))


def decode_column(path: str, pattern: str, ids: str = "ids") -> Column:
    """The bytes that ids, as encode_column gives them, stand for; null ids are none."""
    library = as_library(pattern)

    @pandas_udf("binary")
    def decode(batch: pd.Series) -> pd.Series:
        return pd.Series(coder(path, pattern, library).decode([x or b"" for x in batch]), dtype=object)

    return decode(F.col(ids))


def gathered(batches: Iterator[pd.Series], chars: int) -> Iterator[list[pd.Series]]:
    """Batches in groups of about so many characters."""
    group, size = [], 0
    for batch in batches:
        group.append(batch)
        size += int(batch.str.len().sum())
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with the columns ids and decoded, both binary; columns of these names are replaced."""
    prepare(docs.sparkSession)
    library, both_name = as_library(pattern), fresh(docs, "__kw_coded")

    @pandas_udf("struct<ids:binary,decoded:binary>")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern, library)
        for group in gathered(batches, GATHER_CHARS):
            ids = own.encode([t for batch in group for t in batch])
            at = 0
            for batch in group:
                part = ids[at : at + len(batch)]
                at += len(batch)
                yield pd.DataFrame({"ids": part, "decoded": own.decode(part)})

    out = docs.withColumn(both_name, both(text_or_empty(text)))
    return out.withColumns({"ids": F.col(f"{both_name}.ids"), "decoded": F.col(f"{both_name}.decoded")}).drop(both_name)


def id_list(ids: bytes) -> list[int]:
    return np.frombuffer(ids, "<u4").tolist()
