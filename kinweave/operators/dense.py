"""Nearest neighbours of embeddings by inner product: exact, and in k-means cells.

Vectors are (id, bucket, seq, v). Candidates are packed into blocks where they lie; blocks of references and blocks of
candidates meet by an equi-join on (bucket, part), one matrix product each, and only the best k of a product leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.config import DEFAULTS
from kinweave.operators import metrics
from kinweave.operators.common import ratio, top

BLOCK, PART = 4096, 4


def _pack(frames: Iterator[pd.DataFrame], prefix: str, parts: int) -> Iterator[pd.DataFrame]:
    held: dict[str, list[tuple]] = {}
    made = 0

    def out(bucket: str) -> pd.DataFrame:
        nonlocal made
        made += 1
        rows = held.pop(bucket)
        return pd.DataFrame({"bucket": [bucket], "part": [hash((rows[0][1], made)) % parts], prefix + "ids": [[str(r[0]) for r in rows]], prefix + "seqs": [[int(r[1]) for r in rows]], prefix + "m": [np.stack([np.asarray(r[2], np.float64) for r in rows]).tobytes()]})

    for frame in frames:
        for i, bucket, seq, v in zip(frame["id"], frame["bucket"], frame["seq"], frame["v"], strict=True):
            held.setdefault(bucket, []).append((i, seq, v))
            if len(held[bucket]) >= BLOCK:
                yield out(bucket)
    for bucket in list(held):
        yield out(bucket)


def _first(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest scores of each row, the first columns on ties, best first."""
    n = scores.shape[1]
    if n > k:
        floor = np.partition(scores, n - k, axis=1)[:, n - k, None]
        above, level = scores > floor, scores == floor
        level &= np.cumsum(level, axis=1) <= k - above.sum(axis=1, keepdims=True)
        at = np.nonzero(above | level)[1].reshape(len(scores), k)
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(scores, at, 1), axis=1, kind="stable"), 1)


def _products(frames: Iterator[pd.DataFrame], k: int, digits: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for q_ids, q, c_ids, seqs, c in zip(frame["q_ids"], frame["q_m"], frame["c_ids"], frame["c_seqs"], frame["c_m"], strict=True):
            q, c = (np.frombuffer(m, np.float64).reshape(len(ids), -1) for m, ids in ((q, q_ids), (c, c_ids)))
            order = np.argsort(np.asarray(seqs), kind="stable")
            c, c_ids, seqs = c[order], np.asarray(c_ids, object)[order], np.asarray(seqs)[order]
            scores = np.round(q @ c.T, digits)
            at = _first(scores, k)
            yield pd.DataFrame({"ref_id": np.repeat(np.asarray(q_ids, object), at.shape[1]), "cand_id": c_ids[at.ravel()], "seq": seqs[at.ravel()], "score": np.take_along_axis(scores, at, 1).ravel()})


def exact_knn(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, parts: int | None = None, digits: int = 5) -> DataFrame:
    """The k candidates with the largest inner products for each reference of the bucket; scores rounded to `digits`.

    A part holds about PART blocks of candidates, unless the number of parts is given.
    """
    if parts is None:
        parts = max(4, math.ceil(cands.count() / (BLOCK * PART)))

    def packed(df: DataFrame, prefix: str) -> DataFrame:
        rows = df.select(F.col("id").cast("string").alias("id"), F.col("bucket").cast("string").alias("bucket"), F.col("seq").cast("long").alias("seq"), "v").where("v is not null and bucket is not null")
        return rows.mapInPandas(lambda it: _pack(it, prefix, parts), f"bucket string, part int, {prefix}ids array<string>, {prefix}seqs array<long>, {prefix}m binary")

    c = packed(cands, "c_")
    q = packed(refs, "q_").drop("part").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tiles = q.join(c, ["bucket", "part"]).select("q_ids", "q_m", "c_ids", "c_seqs", "c_m")
    found = tiles.mapInPandas(lambda it: _products(it, k, digits), "ref_id string, cand_id string, seq long, score double")
    return top(found, ["ref_id"], [F.desc("score"), F.col("seq")], k).select("ref_id", "cand_id", "score", "rank")


def fit_cells(cands: DataFrame, cells: int, seed: int = DEFAULTS.seed) -> KMeansModel:
    return KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(cands.where("v is not null").select(array_to_vector("v").alias("features")))


def nearest_cells(model: KMeansModel, probes: int, v: str = "v"):
    """The `probes` nearest cells of a vector, nearest first; the centres travel as one array with the function."""
    centres = np.stack(model.clusterCenters())
    norms = (centres**2).sum(axis=1)

    @pandas_udf("array<int>")
    def near(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(row, np.float64) for row in batch])
        return pd.Series(list(_first(2 * x @ centres.T - norms, min(probes, len(centres))).astype(np.int32)))

    return near(F.col(v))


def ivf_knn(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, cells: int = 32, probes: int = 8) -> DataFrame:
    """Approximate neighbours: candidates lie in the cell of their nearest centre, a reference searches its `probes` nearest cells."""
    model = fit_cells(cands, cells)

    def celled(df: DataFrame, most: int) -> DataFrame:
        rows = df.where("v is not null").withColumn("v", F.col("v").cast("array<double>")).withColumn("cell", F.explode(nearest_cells(model, most)))
        return rows.withColumn("bucket", F.concat_ws("|", F.col("bucket").cast("string"), F.col("cell").cast("string"))).drop("cell")

    return exact_knn(celled(refs, probes), celled(cands, 1), k)


def fit_codebooks(cands: DataFrame, pieces: int = 16, codes: int = 256, sample: int = 20_000, rounds: int = 12) -> np.ndarray:
    """Codebooks of a product quantiser (piece, code, component), by k-means on the `sample` vectors of smallest hash."""
    rows = cands.where("v is not null").select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(sample).collect()
    x = np.array([r["v"] for r in rows], np.float64)
    books = []
    for part in np.split(x, pieces, axis=1):
        book = part[np.linspace(0, len(part) - 1, min(codes, len(part))).astype(int)]
        for _ in range(rounds):
            near = (2 * part @ book.T - (book**2).sum(axis=1)).argmax(axis=1)
            n = np.bincount(near, minlength=len(book))
            total = np.zeros_like(book)
            np.add.at(total, near, part)
            book = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], book)
        books.append(book)
    return np.stack(books)


def encode(cands: DataFrame, books: np.ndarray) -> DataFrame:
    """cands with code, a byte for each piece of the vector: a compressed index, which may be written and read again."""

    @pandas_udf("binary")
    def of(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return pd.Series([], dtype=object)
        x = np.stack([np.asarray(v, np.float64) for v in batch])
        near = [(2 * part @ book.T - (book**2).sum(axis=1)).argmax(axis=1) for part, book in zip(np.split(x, len(books), axis=1), books, strict=True)]
        return pd.Series([row.tobytes() for row in np.stack(near, axis=1).astype(np.uint8)], dtype=object)

    return cands.where("v is not null").withColumn("code", of("v"))


def compressed_knn(refs: DataFrame, cands: DataFrame, k: int = DEFAULTS.top_k, pieces: int = 16, keep: int = 8, books: np.ndarray | None = None) -> DataFrame:
    """Neighbours by a product quantiser: the keep * k best by decoded vectors, ranked again by their own.

    Every candidate is indexed; the codebooks come from a bounded sample. Vectors have one length, a multiple of pieces.
    """
    books = fit_codebooks(cands, pieces) if books is None else books
    coded = encode(cands, books)

    @pandas_udf("array<double>")
    def decoded(batch: pd.Series) -> pd.Series:
        return pd.Series([np.concatenate([book[c] for book, c in zip(books, code, strict=True)]) for code in batch], dtype=object)

    near = exact_knn(refs, coded.withColumn("v", decoded("code")), k * keep)
    pairs = near.select("ref_id", "cand_id").join(refs.select(F.col("id").cast("string").alias("ref_id"), F.col("v").alias("a")), "ref_id").join(cands.select(F.col("id").cast("string").alias("cand_id"), "seq", F.col("v").alias("b")), "cand_id")
    dot = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y)
    scored = pairs.select("ref_id", "cand_id", "seq", F.round(dot, 5).alias("score"))
    return top(scored, ["ref_id"], [F.desc("score"), F.col("seq")], k).select("ref_id", "cand_id", "score", "rank")


def evaluate(refs: DataFrame, truth: DataFrame, found: DataFrame, others: DataFrame, cuts=(1, 5, 10, 50)) -> DataFrame:
    """(n, recall, oracle_f05, union_recall) of a dense channel's lists: recall among the first n, the macro F0.5 of keeping
    just their true ones, and the recall of all of them together with other lists (ref_id, cand_id)."""
    pairs = truth.select("ref_id", "cand_id").distinct()
    both = found.select("ref_id", "cand_id").unionByName(others.select("ref_id", "cand_id")).distinct().join(pairs, ["ref_id", "cand_id"], "left_semi")
    union = both.agg(F.count("*").alias("met")).crossJoin(pairs.agg(F.count("*").alias("pairs"))).select(ratio(F.col("met"), F.col("pairs")).alias("union_recall"))  # two single rows
    rows = metrics.recall_at(found, pairs, cuts).select("n", "recall").join(metrics.oracle_f05(refs, found, pairs, cuts), "n")
    return rows.crossJoin(F.broadcast(union))
