"""SimHash near-duplicates by a self-join of binary tries.

Every text gets a 64-bit fingerprint of its word shingles. The distinct fingerprints form a binary trie; a self-join
follows two of its nodes together, adds up differing bits and leaves a pair of nodes over the budget at once. To deal
the trie to tasks, the 64 bits are cut into parts: fingerprints within the budget agree on all but `budget` of the
parts, so for each choice of that many parts those that agree there are a subtrie of their own, joined with itself.
There are as few parts as keep an even subtrie within BLOCK fingerprints. A task returns a spanning forest of the links
it found, never all pairs of a group, and components are then found by alternating star contractions.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; rows with
equal texts have equal fingerprints and one component; a null doc_id never is a component id, and a component of
rows without ids has a null id; texts of any length count whole; an empty table gives an empty result; other columns
are ignored, and keep_one keeps them as they are.

Scale: a fingerprint is shuffled once for each choice of parts: 5 times up to 2**26 fingerprints, 15 times up to 2**34
and 35 times up to 2**41. Subtries beyond 2 * BLOCK fingerprints are dealt in chunks, so no task needs more than two
chunks in memory; keys with more than SPLIT rows are dealt over several tasks in joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import checkpoint, fresh, prepare, text_or_empty

WORDS, SEED, BUDGET = 4, 42, 4
#: Fingerprints in a subtrie or a chunk of one, and fingerprints gathered before they are joined.
BLOCK, GATHER = 16_384, 100_000
#: Node pairs handled at once, pairs of fingerprints below which a node pair is a leaf, and pairs compared at once.
CHUNK, LEAF, COMPARED = 200_000, 256, 2_000_000
#: Rows of a key in one task of a join, and keys beyond that many rows that are broadcast.
SPLIT, MOST_BROADCAST = 1024, 1_000_000


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a text given as UTF-8."""
    tokens = data.lower().split()
    n = len(tokens)
    if not n:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if n <= words:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, tokens), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - words + 1].tolist()
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: str = "text", words: int = WORDS, seed: int = SEED) -> Column:
    """The fingerprint as a signed long."""

    @pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.fromiter((fingerprint(x, words, seed) for x in batch), np.uint64, len(batch)).view(np.int64))

    return of(text_or_empty(text).cast("binary"))


def trie_pairs(x: np.ndarray, roots: tuple[np.ndarray, ...], bit: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of x that differ in budget bits at most, in chunks, from pairs of nodes followed together.

    roots are (al, ah, bl, bh): of each pair the ranges x[al:ah] and x[bl:bh], sorted, distinct and alike above bit. A
    node beside itself gives each pair once.
    """
    zeros: dict[int, np.ndarray] = {}
    stack = [(bit, (*(r.astype(np.int64) for r in roots), np.full(len(roots[0]), budget)))]
    while stack:
        k, nodes = stack.pop()
        al, ah, bl, bh, left = nodes
        if len(al) > CHUNK:
            stack += [(k, tuple(n[at : at + CHUNK] for n in nodes)) for at in range(0, len(al), CHUNK)]
            continue
        size = (ah - al) * (bh - bl)
        leaf = (size <= LEAF) | (k < 0)
        if leaf.any():
            whole, la, lb, wide = size[leaf], al[leaf], bl[leaf], (bh - bl)[leaf]
            cuts = np.flatnonzero(np.diff(np.cumsum(whole) // COMPARED)) + 1
            for n, pa, pb, w in zip(*(np.split(v, cuts) for v in (whole, la, lb, wide)), strict=True):
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(w, n)
                i, j = np.repeat(pa, n) + within // w, np.repeat(pb, n) + within % w
                near = (np.bitwise_count(x[i] ^ x[j]) <= budget) & ((i < j) | (np.repeat(pa != pb, n)))
                if near.any():
                    yield i[near], j[near]
            al, ah, bl, bh, left = (n[~leaf] for n in nodes)
        if not len(al):
            continue
        if k not in zeros:
            zeros[k] = np.concatenate(([0], np.cumsum((x >> np.uint64(k)) & np.uint64(1) == 0)))
        z = zeros[k]
        am, bm = al + z[ah] - z[al], bl + z[bh] - z[bl]
        one = np.ones(len(al), bool)
        parts = []
        for xl, xh, yl, yh, cost, use in ((al, am, bl, bm, 0, one), (am, ah, bm, bh, 0, one), (al, am, bm, bh, 1, one), (am, ah, bl, bm, 1, al != bl)):  # a node beside itself: of its two mixed pairs, one is enough
            keep = use & (xh > xl) & (yh > yl) & (left >= cost)
            parts.append((xl[keep], xh[keep], yl[keep], yh[keep], left[keep] - cost))
        stack.append((k - 1, tuple(np.concatenate(n) for n in zip(*parts, strict=True))))


def link(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the trees of i and j, vectorised; parents are smaller than their children, trees are flat afterwards."""
    while True:
        pi, pj = parent[i], parent[j]
        apart = pi != pj
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        np.minimum.at(parent, np.maximum(pi, pj)[apart], np.minimum(pi, pj)[apart])
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def _whole_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames of GATHER rows or more, sorted by keys, that cut no group of equal keys."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        held.append(frame)
        if sum(map(len, held)) >= GATHER:
            rows = pd.concat(held, ignore_index=True)
            last = (rows[keys] == rows[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(rows) - int(np.argmin(last[::-1])) if not last.all() else 0
            if cut:
                yield rows[:cut]
            held = [rows[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _forest(frames: Iterator[pd.DataFrame], keys: list[str], budget: int, sided: bool) -> Iterator[pd.DataFrame]:
    """A spanning forest of the links within each group of equal keys; sided: if a group has two sides, those between them."""
    for rows in _whole_groups(frames, keys):
        x, group = rows["fp"].to_numpy().view(np.uint64), np.cumsum(np.append(True, (rows[keys].to_numpy()[1:] != rows[keys].to_numpy()[:-1]).any(axis=1)))
        side = rows["side"].to_numpy() if sided else np.zeros(len(x), np.int64)
        order = np.lexsort((x, side, group))
        x, group, side = x[order], group[order], side[order]
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])))
        last = np.append(first[1:], len(x))
        mixed = np.append(group[first][1:] == group[first][:-1], False)  # its group's other side follows
        alone = ~mixed & ~np.append(False, mixed[:-1])
        roots = tuple(np.concatenate((a[mixed], b[alone])) for a, b in ((first, first), (last, last), (np.append(first[1:], 0), first), (np.append(last[1:], 0), last)))
        parent = np.arange(len(x))
        for i, j in trie_pairs(x, roots, 63, budget):
            parent = link(parent, i, j)
        child = np.flatnonzero(parent != np.arange(len(x)))
        yield pd.DataFrame({"u": x[child].view(np.int64), "v": x[parent[child]].view(np.int64)})


def part_masks(n: int, budget: int) -> list[int]:
    """For each choice of parts the bits that fingerprints must agree on, as signed longs; of n even ones BLOCK agree at most."""
    count = budget + 1
    while count < 64 and n >> (64 // count * (count - budget)) > BLOCK:
        count += 1
    cuts = [64 * i // count for i in range(count + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(parts, count - budget))]


def links(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp) whose closure is that of all pairs within the budget."""
    fps = checkpoint(prints.select("fp").distinct())
    masks = part_masks(fps.count(), budget)
    dealt = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for g, m in enumerate(masks)])).alias("x")).select("fp", "x.g", "x.key")
    heavy = dealt.groupBy("g", "key").count().where(F.col("count") > 2 * BLOCK)
    heavy = checkpoint(heavy.select("g", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("chunks")))
    n = heavy.count()
    shared = F.broadcast(heavy) if n <= MOST_BROADCAST else heavy
    light = dealt if not n else dealt.join(shared, ["g", "key"], "left_anti")
    # groups whose hashes collide are joined as one, which finds the same links
    light = light.select(F.xxhash64("g", "key").alias("group"), "fp").repartition("group").sortWithinPartitions("group")
    out = light.mapInPandas(lambda it: _forest(it, ["group"], budget, False), "u long, v long")
    if n:
        own = dealt.join(shared, ["g", "key"]).withColumn("side", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        own = own.select("g", "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "fp")
        keys = ["g", "key", "i", "j"]
        out = out.unionByName(own.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(lambda it: _forest(it, keys, budget, True), "u long, v long"))
    return out


def spread_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left.join(right, key), where right has each key once, with n, its rows in left: those of keys with more than SPLIT are dealt over several tasks."""
    hot = right.where(F.col("n") > SPLIT).select(key, F.ceil(F.col("n") / SPLIT).cast("int").alias("__kw_tasks"))
    if not 0 < hot.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return left.join(right.drop("n"), key)
    tasks = F.coalesce("__kw_tasks", F.lit(1))
    left = left.join(F.broadcast(hot), key, "left").withColumn("__kw_task", F.pmod(F.xxhash64(*left.columns), tasks).cast("int")).drop("__kw_tasks")
    right = right.drop("n").join(F.broadcast(hot), key, "left").withColumn("__kw_task", F.explode(F.sequence(F.lit(0), tasks - 1))).drop("__kw_tasks")
    return left.join(right, [key, "__kw_task"]).drop("__kw_task")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (u, v); root is the smallest node in reach. Alternating large and small stars."""
    now = checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = checkpoint(spread_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = spread_join(large, least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        now = checkpoint(small)
        new = tuple(now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def _text_key(text: str) -> Column:
    return F.xxhash64(text_or_empty(text))


def _grouped(docs: DataFrame, words: int, budget: int, text: str) -> DataFrame:
    """(doc_id, h, fp, first) of each row; h is a hash of the text, first the least (without id, doc_id, h) of the row's component."""
    prepare(docs.sparkSession)
    prints = checkpoint(docs.select("doc_id", _text_key(text).alias("h"), fingerprint_column(text, words).alias("fp")))
    per = checkpoint(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "h")).alias("first"), F.count("*").alias("n")))
    roots = components(links(per, budget)).withColumnRenamed("node", "fp")
    rooted = checkpoint(per.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first", F.col("n").alias("rows")))
    least = checkpoint(rooted.groupBy("root").agg(F.min("first").alias("least"), F.count("*").alias("n")))
    named = checkpoint(spread_join(rooted.drop("first"), least, "root").select("fp", F.col("least").alias("first"), F.col("rows").alias("n")))
    return checkpoint(spread_join(prints, named, "fp").select("doc_id", "h", "fp", "first"))


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, text: str = "text") -> DataFrame:
    """One row per document: doc_id, fp (signed long), component_id."""
    return _grouped(docs, words, budget, text).select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """docs with one row of each component, that with the smallest doc_id; rows without an id come last.

    Of rows with that id the one stays whose text has the least hash, and of equal ids and texts one, chosen by its other
    columns. Rows go by id and text, so equal ids with different texts are told apart. Keys to drop are broadcast up to
    most_broadcast of them; beyond that they are joined by shuffling.
    """
    found = _grouped(docs, words, budget, text)
    key, i, h = (fresh(docs, x) for x in ("__kw_key", "__kw_id", "__kw_h"))
    pair = (F.col("doc_id").alias(i), F.col("h").alias(h))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    gone = checkpoint(found.where(~stays).select(*pair).distinct())
    keyed = docs.withColumn(key, _text_key(text))
    same = F.col("doc_id").eqNullSafe(F.col(i)) & (F.col(key) == F.col(h))
    kept = keyed.join(F.broadcast(gone) if gone.count() <= most_broadcast else gone, same, "left_anti")
    often = checkpoint(found.where(stays).groupBy("doc_id", "h").count().where("count > 1").select(*pair))
    n = often.count()
    if not n:
        return kept.drop(key)
    shared = F.broadcast(often) if n <= most_broadcast else often
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = kept.join(shared, same, "left_semi").groupBy("doc_id", key).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias(key + "_row")).select(f"{key}_row.*")
    return kept.join(shared, same, "left_anti").drop(key).unionByName(one)
