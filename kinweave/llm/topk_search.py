"""Exact top-k search by inner product: tiles of queries and shards, partial selection, merging in a tree.

Vectors are packed, as the narrowest integers that hold them, into shards of SHARD rows and queries into blocks of about
BLOCK. A tile is one block beside PART shards: for each shard a matrix product in strips of the block, a selection of the
k best of each query, and a merge with the tile's best so far. The lists of a query from its tiles are merged FAN at a
time until one is left, so no task gathers all lists of a query.

Scale: a tile holds a block and one shard unpacked, and k results for each of its queries. A vector is shuffled once for
each block, a query and its k results once for each tile of its block: of n vectors and m queries n * m / 131,072 packed
vectors travel, and n * m / 1,048,576 lists. That product is the work of an exact search too.

Defined cases: components are floor(scale * x); vectors that are null or hold null or non-finite components take no
part, nor do rows without an id; vectors of unequal lengths have no score; a query's own id is no candidate; a repeated
query id is asked once, with its largest vector; repeated candidate rows each count; ties go to the smaller id; scores
beyond 2**63 - 1 in size count as that; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.llm.common import prepare

SHARD, PART, BLOCK, FAN, STRIP = 8192, 128, 131_072, 16, 256
#: Tiles beside a block where there are shards enough, so that small tables keep several tasks busy.
TILES = 8
MOST = 2**63 - 1
PACKED = "dim int, kind string, ids binary, rows binary"


def integer_vectors(vectors: DataFrame, scale: int = 64, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, as whole numbers held in doubles."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector_id).isNotNull() & F.col(vector).isNotNull()).where(~bad)
    return rows.select(F.col(vector_id).cast("long").alias("vec_id"), F.transform(F.col(vector), lambda x: _floor(x, scale)).alias("v"))


def _floor(x, scale: int):
    """floor as a double: F.floor gives a long, which large values overflow."""
    y = x.cast("double") * float(scale)
    return F.when(F.abs(y) < 2.0**52, F.floor(F.when(F.abs(y) < 2.0**52, y).otherwise(0.0)).cast("double")).otherwise(y)


def narrow(data: np.ndarray) -> np.ndarray:
    """Whole numbers held in doubles, in the narrowest type that holds them."""
    most = np.abs(data).max(initial=0)
    return data.astype(next((t for t in ("int8", "int16", "int32") if most <= np.iinfo(t).max), "float64"))


def unpack(dim: int, kind: str, ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(rows, kind).reshape(len(ids), dim).astype(np.float64)


def _pack(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Shards of at most `rows` vectors of one length, in the order in which they come."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def out(dim: int) -> pd.DataFrame:
        ids = np.array([i for i, _ in held[dim]], np.int64)
        data = narrow(np.stack([v for _, v in held.pop(dim)]) if dim else np.zeros((len(ids), 0)))
        return pd.DataFrame({"dim": [dim], "kind": [data.dtype.str], "ids": [ids.tobytes()], "rows": [data.tobytes()]})

    for frame in frames:
        for i, v in zip(frame["vec_id"], frame["v"], strict=True):
            dim = len(v)
            held.setdefault(dim, []).append((i, np.asarray(v, np.float64)))
            if len(held[dim]) >= rows:
                yield out(dim)
    for dim in list(held):
        yield out(dim)


def scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in floats that hold them all, else as Python integers."""
    most = (np.abs(q).max(initial=0) * np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 2.0**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64)
    if most < 2.0**53:
        return (q @ c.T).astype(np.int64)
    as_int = np.frompyfunc(int, 1, 1)
    exact = as_int(q).astype(object) @ as_int(c).astype(object).T
    return np.frompyfunc(lambda x: max(-MOST, min(MOST, x)), 1, 1)(exact).astype(np.int64)


def best_of(q_ids: np.ndarray, c_ids: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query: (row, id, score), best first, ties to smaller ids. c_ids ascend."""
    own = c_ids[None, :] == q_ids[:, None]
    n, room = s.shape[1], (~own).sum(axis=1)
    if n and np.abs(s).max(initial=0) < 2**62 // (n + 1):
        # place and score in one number, all distinct
        key = s * n + (n - 1 - np.arange(n))
        key[own] = -MOST
        at = np.argpartition(key, n - k, axis=1)[:, n - k :] if n > k else np.broadcast_to(np.arange(n), key.shape)
        at = np.take_along_axis(at, np.argsort(-np.take_along_axis(key, at, 1), axis=1), 1)
    else:
        at = np.argsort(np.where(own, MOST, -s), axis=1, kind="stable")
        # own ids, which may tie with the least score, go last
        at = np.take_along_axis(at, np.argsort(np.take_along_axis(own, at, 1), axis=1, kind="stable"), 1)[:, :k]
    row, col = np.nonzero(np.arange(at.shape[1])[None, :] < np.minimum(room, k)[:, None])
    at = at[row, col]
    return row, c_ids[at], s[row, at]


def tile(asks: pd.DataFrame, shards: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query_id, vec_id, score): the k best of the shards for each query of a block.

    After a strip's first shard only scores that reach the query's k-th best so far are looked at.
    """
    held: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}  # by block and strip: row, id and score of the best so far, and each query's floor
    blocks = [(dim, *unpack(dim, *packed)) for dim, *packed in zip(asks["dim"], asks["kind"], asks["ids"], asks["rows"], strict=True)]
    for dim, *packed in zip(shards["dim"], shards["kind"], shards["ids"], shards["rows"], strict=True):
        if all(d != dim for d, _, _ in blocks):
            continue
        c_ids, c = unpack(dim, *packed)
        order = np.argsort(c_ids, kind="stable")
        c_ids, c = c_ids[order], c[order]
        for b, (d, q_ids, q) in enumerate(blocks):
            for at in range(0, len(q), STRIP) if d == dim else ():
                ids = q_ids[at : at + STRIP]
                s = scores(q[at : at + STRIP], c)
                if (b, at) not in held:
                    row, vec, score = best_of(ids, c_ids, s, k)
                else:
                    row, vec, score, floor = held[b, at]
                    r, j = np.nonzero(s >= floor[:, None])
                    other = c_ids[j] != ids[r]
                    r, j = r[other], j[other]
                    if not len(r):
                        continue
                    row, vec, score = np.append(row, r), np.append(vec, c_ids[j]), np.append(score, s[r, j])
                    order = np.lexsort((vec, -score, row))
                    row, vec, score = row[order], vec[order], score[order]
                    keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, vec, score = row[keep], vec[keep], score[keep]
                n = np.bincount(row, minlength=len(ids))
                floor = np.full(len(ids), -MOST)
                floor[n == k] = score[np.cumsum(n)[n == k] - 1]
                held[b, at] = row, vec, score, floor
    out = [pd.DataFrame({"query_id": blocks[b][1][at : at + STRIP][row], "vec_id": vec, "score": score}) for (b, at), (row, vec, score, _) in held.items()]
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, vector_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of each query."""
    prepare(vectors.sparkSession)
    cands = integer_vectors(vectors, scale, vector_id, vector)
    asked = integer_vectors(queries, scale, vector_id, vector).groupBy("vec_id").agg(F.max("v").alias("v"))
    n, m = cands.count(), asked.count()
    blocks, parts = max(1, math.ceil(m / BLOCK)), max(math.ceil(n / (SHARD * PART)), min(TILES, math.ceil(n / SHARD)), 1)

    def dealt(rows: DataFrame, name: str, into: int, each: str, of: int) -> DataFrame:
        """Packed rows, each dealt to one of `into` and beside every one of `of`."""
        packed = rows.mapInPandas(lambda it: _pack(it, SHARD), PACKED).withColumn(name, F.pmod(F.xxhash64("ids"), F.lit(into)).cast("int"))
        return packed.withColumn(each, F.explode(F.sequence(F.lit(0), F.lit(of - 1))))

    shards, asks = dealt(cands, "part", parts, "block", blocks), dealt(asked, "block", blocks, "part", parts)
    tiles = asks.groupBy("block", "part").cogroup(shards.groupBy("block", "part"))
    found = tiles.applyInPandas(lambda key, a, b: tile(a, b, k).assign(part=key[1]), "query_id long, vec_id long, score long, part int")
    width = parts

    def merge(df: DataFrame, *keys) -> DataFrame:
        lists = F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("i")))
        return df.groupBy("query_id", *keys).agg(F.slice(F.sort_array(lists), 1, k).alias("best"))

    while width > FAN:
        width = math.ceil(width / FAN)
        found = merge(found, F.pmod("part", F.lit(width)).alias("part")).select("query_id", "part", F.explode("best").alias("x")).select("query_id", F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"), "part")
    best = merge(found).select("query_id", F.posexplode("best").alias("at", "x"))
    return best.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score"))
