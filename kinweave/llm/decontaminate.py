"""Benchmark passages in documents, within an edit distance in words or in characters.

Texts are lower-cased word sequences (a character of a script written without spaces is a word); words that no passage
has count as one. The CGK random walk reads a sequence with a pointer that stays or moves on by a random bit of the
word it reads, and so turns edit distance into Hamming distance of the words read. Walks start at every word of a
passage and at every word of a document that any passage has; each walk's sampled steps are a key, and equal keys give a
passage and the place where it would begin. Sampled steps must lie on at least DISTINCT places, since a pointer that
stays reads nothing new. The place there must hold enough of the passage's words, and is then verified by exact
semi-global edit distance: at most `tolerance` edits for each word or, failing that, `char_tolerance` edits for each
character of the passage.

Windows are not as long as their items: a walk over a whole item meets so many of the allowed edits that its samples
rarely agree. Among the n words of a copy with floor(0.2 n) edited, some run of about four words is whole, and walks of
STEPS steps that start there agree; WALKS repetitions bring every length to the recall that the README lists.

Passages below SHORT words may hold no whole run of that length. They are also found by exact pieces, one more than the
edits allowed, of which one is whole in any copy.

Passages are read in blocks of BLOCK_CHARS characters, each broadcast once; a benchmark of any size is so many blocks,
and after every CHAIN blocks the documents are checkpointed, so that no task holds more than CHAIN indexes.

Defined cases: null texts are empty; a passage without words never matches; an item_id may be null or repeated, each
row of the benchmark is its own passage; a document meets a passage once, by words if it can, at the least distance and
then the first place; texts of any length are matched whole; repeated documents give repeated rows; empty tables give
empty results; other columns are kept, a column named like the output is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import checkpoint, fresh, prepare, text_or_empty

#: Edits allowed for each word, and for each character, of a passage.
TOLERANCE, CHAR_TOLERANCE = 0.2, 0.1
WALKS, STEPS, SAMPLED, DISTINCT, SHORT = 4, 6, 4, 3, 10
#: Proposed places whose words are counted at once.
COUNTED = 20_000
#: Characters of passages in a block, and blocks between checkpoints.
BLOCK_CHARS, CHAIN = 2_000_000, 4
SEED = 42
#: Scripts written without spaces between words: Thai to Tibetan, Burmese, Khmer, kana and Han.
UNSPACED = "฀-࿿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff"
WORD, HAS_UNSPACED, MIXED = re.compile(r"\w+"), re.compile(f"[{UNSPACED}]"), re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def words_of(text: str) -> list[str]:
    low = text.lower()
    return (MIXED if not low.isascii() and HAS_UNSPACED.search(low) else WORD).findall(low)


def ends(pattern: Sequence, text: Sequence, anchored: bool) -> Iterator[int]:
    """The edit distance of pattern to the best substring that ends after each prefix of text, the empty one first.

    If anchored, the substring begins where text does. Rows of the distance matrix are bits of integers of any size.
    """
    where: dict = {}
    for i, x in enumerate(pattern):
        where[x] = where.get(x, 0) | 1 << i
    full, last, carry = (1 << len(pattern)) - 1, 1 << max(0, len(pattern) - 1), int(anchored)
    up, down, score, get = full, 0, len(pattern), where.get
    yield score
    for x in text:
        eq = get(x, 0)
        level = (((eq & up) + up) ^ up) | eq | down
        more, less = down | (full & ~(level | up)), up & level
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more, less = (more << 1) | carry, less << 1
        mix = eq | down
        up, down = (less | ~(mix | more)) & full, more & mix & full
        yield score


def nearest(pattern: Sequence, text: Sequence) -> tuple[int, int, int]:
    """(distance, start, end): the substring of text with the least edit distance to pattern; the first to end, then the longest."""
    pattern, text = (x.tolist() if isinstance(x, np.ndarray) else x for x in (pattern, text))
    far, end = min((d, j) for j, d in enumerate(ends(pattern, text, False)))
    back = list(ends(pattern[::-1], text[:end][::-1], True))
    return far, end - max(j for j, d in enumerate(back) if d == far), end


@dataclass
class Index:
    items: list[tuple[int | None, np.ndarray]]
    phrases: list[str]
    grams: list[np.ndarray]
    lengths: np.ndarray
    edits: np.ndarray
    char_edits: np.ndarray
    vocabulary: dict[str, int]
    bits: np.ndarray
    steps: np.ndarray
    keys: list[np.ndarray]
    windows: list[np.ndarray]
    item_of: np.ndarray
    offset: np.ndarray
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    member: np.ndarray

    def sample(self, ids: np.ndarray, at: np.ndarray, w: int) -> np.ndarray:
        """A key of what walk w reads in its sampled steps from each place; -1 if that isn't all passages' words, or too few places."""
        at, key, valid = at.copy(), np.zeros(len(at), np.int64), np.ones(len(at), bool)
        places, last = np.ones(len(at), np.int8), None
        for j in range(self.steps[w][-1] + 1):
            read = ids[at]
            if j in self.steps[w]:
                valid &= read > 1
                key *= 1_000_003
                key += read
                if last is not None:
                    places += at != last
                last = at.copy()
            at += self.bits[w, j][read]
        return np.where(valid & (places >= DISTINCT), key & (2**62 - 1), -1)


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """A key of each run of n words, by its first; -1 where one of them isn't a passage's word."""
    key, valid = np.zeros(len(ids) - n + 1, np.int64), np.ones(len(ids) - n + 1, bool)
    for j in range(n):
        part = ids[j : len(ids) - n + 1 + j]
        valid &= part > 1
        key = key * 1_000_003 + part
    return np.where(valid, key & (2**62 - 1), -1)


def short_pieces(items: list[tuple[int | None, np.ndarray]], edits: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: keys, passages and offsets of the pieces of short passages, sorted by key."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for p, (_, words) in enumerate(items):
        if len(words) < SHORT:
            n = min(len(words), int(edits[p]) + 1)
            cuts = [len(words) * i // n for i in range(n + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(b - a, []).append((int(runs(words[a:b], b - a)[0]), p, a))
    return {n: tuple(np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) for n, rows in found.items()}


def build(rows: list[tuple[int | None, str]], tolerance: float = TOLERANCE, char_tolerance: float = CHAR_TOLERANCE) -> Index:
    """An index of passages; ids: 0 ends a text, 1 is any word that no passage has."""
    vocabulary: dict[str, int] = {}
    split = [(i, w) for i, t in rows if (w := words_of(t))]
    items = [(i, np.array([vocabulary.setdefault(x, len(vocabulary) + 2) for x in w], np.int32)) for i, w in split]
    phrases = [" ".join(w) for _, w in split]
    lengths = np.array([len(x) for _, x in items], np.int64)
    edits, char_edits = np.floor(tolerance * lengths + 1e-9).astype(np.int64), np.array([math.floor(char_tolerance * len(x) + 1e-9) for x in phrases], np.int64)
    r, v = np.random.default_rng(SEED), len(vocabulary) + 2
    bits = r.integers(0, 2, (WALKS, STEPS, v)).astype(np.int64)
    bits[:, :, 0] = 0
    steps = np.array([np.append(0, 1 + np.sort(r.choice(STEPS - 1, SAMPLED - 1, replace=False))) for _ in range(WALKS)])
    none = np.zeros(0, np.int64)
    index = Index(items, phrases, [np.unique(grams_of(x)) for x in phrases], lengths, edits, char_edits, vocabulary, bits, steps, [], [], none, none, short_pieces(items, edits), none)
    if not items:
        return index
    flat = np.concatenate([np.concatenate((x, np.zeros(STEPS, np.int32))) for _, x in items])
    index.item_of = np.repeat(np.arange(len(items)), lengths)
    index.offset = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    at = index.offset + np.repeat(np.cumsum(lengths + STEPS) - lengths - STEPS, lengths)
    index.member = np.unique(index.item_of * v + flat[at])
    for w in range(WALKS):
        key = index.sample(flat, at, w)
        order = np.argsort(key, kind="stable")
        order = order[np.searchsorted(key[order], 0) :]
        index.keys.append(key[order])
        index.windows.append(order)
    return index


def _meet(keys: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) with key[i] == keys[j] of the sorted keys."""
    low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
    hit = np.flatnonzero(high > low)
    n = (high - low)[hit]
    return np.repeat(hit, n), np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _near(index: Index, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, passage) pairs proposed for the words at `first`; the place is where the passage would begin."""
    places, passages = [], []
    known = first[ids[first] > 1]
    for w in range(WALKS):
        key = index.sample(ids, known, w)
        use = np.flatnonzero(key >= 0)
        i, j = _meet(index.keys[w], key[use])
        which = index.windows[w][j]
        places.append(known[use[i]] - index.offset[which])
        passages.append(index.item_of[which])
    for n, (keys, of, offset) in index.pieces.items():
        if len(ids) >= n:
            key = runs(ids, n)
            own = first[first < len(key)]
            i, j = _meet(keys, key[own])
            places.append(own[i] - offset[j])
            passages.append(of[j])
    return np.concatenate(places), np.concatenate(passages)


def match(index: Index, texts: list[str]) -> list[list[dict]]:
    """For each text the passages it holds."""
    out: list[list[dict]] = [[] for _ in texts]
    if not index.items:
        return out
    words, gap = [words_of(t) for t in texts], [0] * STEPS
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter(chain.from_iterable(chain(map(index.vocabulary.get, w, repeat(1)), gap) for w in words), np.int32, lengths.sum() + len(words) * STEPS)
    starts = np.cumsum(lengths + STEPS) - lengths - STEPS
    first = np.arange(lengths.sum()) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    places, passages = _near(index, flat, first) if len(first) else (first, first)
    if not len(places):
        return out
    reach = np.maximum(1, index.edits)
    # a place before its text's first word lies in the gap before it, or in the text before: try both texts
    doc, ahead = (np.searchsorted(starts, x, "right") - 1 for x in (places, places + reach[passages]))
    other = ahead != doc
    seen = np.stack((np.append(doc, ahead[other]), np.append(passages, passages[other]), np.append(places, places[other])), axis=1)
    seen = seen[seen[:, 0] >= 0]
    seen = seen[np.lexsort((seen[:, 2], seen[:, 1], seen[:, 0]))]
    if len(seen):
        seen = seen[np.append(True, (seen[1:] != seen[:-1]).any(axis=1))]
        held = _held(index, flat, starts, lengths, seen)
        enough = held >= index.lengths[seen[:, 1]] - index.edits[seen[:, 1]]
        seen = np.column_stack((seen, enough))[enough | (index.char_edits[seen[:, 1]] > 0)]
    else:
        seen = np.zeros((0, 4), np.int64)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    by_chars: dict[tuple[int, int], tuple[int, int, int]] = {}
    covered: dict[tuple[int, int, int], int] = {}
    letters: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # 3-grams of a text's words, and where each word begins
    for d, p, place, enough in seen.tolist():
        pair, pattern, edits = (d, p), index.items[p][1], int(index.edits[p])
        n, begin = len(pattern), int(starts[d])
        old, size = best.get(pair), int(lengths[d])
        if old is not None and (old[0] == 0 or not enough) or place < covered.get((d, p, enough), -STEPS - n):
            continue
        at = place - begin
        if 0 <= at and at + n <= size and (flat[place : place + n] == pattern).all():
            best[pair] = (0, at, at + n)
            continue
        covered[d, p, enough] = place + max(1, edits)
        low = min(size, max(0, at - 2 * edits - 2))
        high = max(low, min(size, at + n + 4 * edits + 3))
        if enough:
            far, a, b = nearest(pattern, flat[begin + low : begin + high])
            if far <= edits:
                best[pair] = min(old or (far, low + a, low + b), (far, low + a, low + b))
        if pair in best or not index.char_edits[p]:
            continue
        if d not in letters:
            letters[d] = grams_of(" ".join(words[d])), np.cumsum([0, *map(len, words[d])]) + np.arange(size + 1)
        grams, begins = letters[d]
        if found := _by_chars(words[d][low:high], grams[begins[low] : max(0, begins[high] - 3)], index, p):
            found = (found[0], low + found[1], low + found[2])
            by_chars[pair] = min(by_chars.get(pair, found), found)
    rows = {k: (far, None, a, b) for k, (far, a, b) in best.items()} | {k: (None, far, a, b) for k, (far, a, b) in by_chars.items() if k not in best}
    for (d, p), (far, chars, a, b) in sorted(rows.items()):
        out[d].append({"item_id": index.items[p][0], "start_word": a, "end_word": b, "distance": far, "char_distance": chars, "n_words": len(index.items[p][1])})
    return out


def grams_of(text: str) -> np.ndarray:
    """The 3-grams of a text's characters as integers."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return x[:-2] << 42 | x[1:-1] << 21 | x[2:]


def _by_chars(words: list[str], grams: np.ndarray, index: Index, p: int) -> tuple[int, int, int] | None:
    """(distance, first word, end word) of the passage's nearest place in the words, if few enough characters differ.

    An edit touches three 3-grams at most, so any such place has all but three for each edit, and is as long but for the edits.
    """
    phrase, own, most = index.phrases[p], index.grams[p], int(index.char_edits[p])
    least, size = len(phrase) - 2 - 3 * most, len(phrase) + most - 2
    if least > 0:
        count = np.concatenate(([0], np.cumsum(own[np.minimum(np.searchsorted(own, grams), len(own) - 1)] == grams)))
        if (count[size:] - count[:-size] if len(count) > size else count[-1:]).max() < least:
            return None
    text = " ".join(words)
    if min(ends(phrase, text, False)) > most:
        return None
    far, a, b = nearest(phrase, text)
    return far, text.count(" ", 0, a), text.count(" ", 0, max(a, b - 1)) + 1


def _held(index: Index, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How many words of the passage the region about each (text, passage, place) holds."""
    out, v = np.zeros(len(seen), np.int64), len(index.vocabulary) + 2
    for at in range(0, len(seen), COUNTED):
        d, p, place = seen[at : at + COUNTED].T
        n, e = index.lengths[p], index.edits[p]
        low, high = np.maximum(starts[d], place - 2 * e - 2), np.minimum(starts[d] + lengths[d], place + n + 2 * e + 2)
        size = np.maximum(high - low, 0)
        first = np.cumsum(size) - size
        code = np.repeat(p, size) * v + flat[np.repeat(low - first, size) + np.arange(size.sum())]
        found = np.searchsorted(index.member, code)
        hit = np.concatenate(([0], np.cumsum(index.member[np.minimum(found, len(index.member) - 1)] == code)))
        out[at : at + COUNTED] = hit[first + size] - hit[first]
    return out


MATCHES = "array<struct<item_id:long,start_word:int,end_word:int,distance:int,char_distance:int,n_words:int>>"


def find_passages(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, char_tolerance: float = CHAR_TOLERANCE, text: str = "text", item_text: str = "text", to: str = "passages") -> DataFrame:
    """docs with the column `to`: for each passage of the benchmark that a document holds, where and how near."""
    spark = docs.sparkSession
    prepare(spark)
    rows = benchmark.select("item_id", text_or_empty(item_text).alias("t"))
    chars = rows.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    held = fresh(docs, "__kw_passages")
    out = docs.withColumn(held, F.array().cast(MATCHES))
    for k in range(n):
        block = rows.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n)) == k).orderBy("item_id", "t").collect()
        index = spark.sparkContext.broadcast(build([(r["item_id"], r["t"]) for r in block], tolerance, char_tolerance))

        def column(shared):
            @pandas_udf(MATCHES)
            def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
                for batch in batches:
                    yield pd.Series(match(shared.value, batch.tolist()), dtype=object)

            return find(text_or_empty(text))

        out = out.withColumn(held, F.concat(held, column(index)))
        if k % CHAIN == CHAIN - 1 and k < n - 1:
            out = checkpoint(out)
    return out.drop(to).withColumnRenamed(held, to)
