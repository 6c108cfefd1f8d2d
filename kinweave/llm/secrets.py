"""Secrets in texts: an Aho-Corasick pass over keywords, anchored expressions at the hits, checksums at last.

Kinds, in this order: assign, access and hex are the base; github and npm tokens count only if their embedded CRC32
agrees, jwt only if its header is JSON that names an algorithm, pem is a private key from its first line through
the matching last line or, without one, through the base64 lines that follow. Runs of hex
digits have no keyword; they are scanned for directly. Matches of a kind don't overlap, the leftmost comes first.

Defined cases: a null text is empty and has no secrets, and stays null when redacted; repeated rows give repeated rows;
texts of any length are scanned whole; offsets are code points, the end is exclusive; an empty table
gives an empty result; other columns are kept, columns named like the output are replaced.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import prepare, text_or_empty

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "github", "npm", "jwt", "pem")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
GITHUB = re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]{16,}")
#: What may stand between the lines of a key: blanks, quotes, marks of quoted or commented lines, escaped line ends.
GAP = rb"(?:[\s\"',>#*|]|\\[nrt])*+"
PEM = re.compile(
    rb"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END \1-----"
    rb"|(?:" + GAP + rb"[A-Z][A-Za-z]*-[A-Z][A-Za-z]*: [^\r\n\\]*)*(?:" + GAP + rb"[A-Za-z0-9+/]{16,}={0,2})+(?:" + GAP + rb"[A-Za-z0-9+/]+={0,2}(?![A-Za-z0-9+/]))?|)"
)
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> bytes:
    out = b""
    while n:
        n, k = divmod(n, 62)
        out = DIGITS[k : k + 1] + out
    return out.rjust(width, b"0")


def sums_up(body: bytes) -> bool:
    """Whether the last six of 36 characters are the CRC32 of the others in base 62."""
    return base62(zlib.crc32(body[:30]), 6) == body[30:]


def names_algorithm(header: bytes) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(header + b"=" * (-len(header) % 4)))
    except (ValueError, TypeError):
        return False


CHECKS = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6),
    "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, lambda m: sums_up(m[1])),
    "npm": (NPM, lambda m: sums_up(m[1])),
    "jwt": (JWT, lambda m: names_algorithm(m[1])),
    "pem": (PEM, lambda m: True),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def scan(data: bytes) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the UTF-8 text data, by start and then by kind."""
    near: dict[str, list[int]] = {}
    for last, (kind, n) in automaton().iter(data.lower().decode("latin-1")):
        near.setdefault(kind, []).append(last - n + 1)
    found = [("hex", *m.span()) for m in HEX.finditer(data)]
    for kind, starts in near.items():
        (pattern, valid), at = CHECKS[kind], 0
        for start in sorted(starts):
            if start >= at and (m := pattern.match(data, start)):
                at = m.end()
                if valid(m):
                    found.append((kind, *m.span()))
    if found and not data.isascii():
        points = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))).tolist()
        found = [(kind, points[a], points[b]) for kind, a, b in found]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def secrets_column(text: str = "text") -> Column:
    @pandas_udf(SPANS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(x)] for x in batch], dtype=object)

    return find(text_or_empty(text).cast("binary"))


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column secrets: all spans, sorted by start and then by kind."""
    prepare(docs.sparkSession)
    return docs.withColumn("secrets", secrets_column(text))


def redact_text(text: str, mark: str = "[secret]") -> str:
    out, at = [], 0
    for _, a, b in scan(text.encode()):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every secret replaced by mark; overlapping spans become one mark; null texts stay null."""
    prepare(docs.sparkSession)

    @pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else redact_text(x, mark) for x in batch], dtype=object)

    return docs.withColumn(text, clean(F.col(text)))
