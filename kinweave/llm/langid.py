"""Language identification by the nearest of several centroids per language.

A text is lower-cased; what isn't a letter becomes a space; hashed byte 2- and 3-grams are counted, damped, weighted by
inverse document frequency and normalised. Spherical k-means gives each language CENTROIDS centroids; the language of
the centroid with the largest cosine wins. A text further from it than nearly all training texts is rejected.

The fit uses a sample of labelled texts, chosen by a hash: about PER_LANGUAGE of each language and MOST in all at most.
Many languages share MOST evenly; what the rare ones leave goes to the others.

Defined cases: a null text, or one without letters, is `und`, has score 0 and is rejected; without any labelled text
every language is `und`; ties go to the language that sorts first; rows without a label or whose doc_id is null are
never learned from; repeated rows are learned from and judged as often as they stand; texts of any length count whole; an
empty table gives an empty result; other columns are kept by judge, and by identify but for those named like its outputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import fresh, prepare, text_or_empty

BITS = 12
CENTROIDS, PER_LANGUAGE, MOST = 3, 400, 4000
#: A text is rejected below this share of the cosine that all but the REJECT_QUANTILE of training texts reach.
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.5

_letters = np.full(256, 32, np.uint8)
_letters[97:123] = np.arange(97, 123)
_letters[128:] = np.arange(128, 256)


def grams(text: str) -> np.ndarray:
    """Counts of hashed n-grams."""
    raw = _letters[np.frombuffer((" " + text.lower() + " ").encode("utf-8", "replace"), np.uint8)].astype(np.uint32)
    two = (raw[:-1] << np.uint32(8)) | raw[1:]
    three = (two[:-1] << np.uint32(8)) | raw[2:]
    codes = np.concatenate((two[two != 0x2020], three[three != 0x202020])) * np.uint32(2654435761)
    return np.bincount(codes >> np.uint32(32 - BITS), minlength=1 << BITS).astype(np.float32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floor: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, cosines, and whether each text is rejected."""
        lettered = np.array([has_letter(t) for t in texts], bool)
        names, score, reject = np.full(len(texts), "und", object), np.zeros(len(texts)), np.ones(len(texts), bool)
        if self.languages and lettered.any():
            at = np.flatnonzero(lettered)
            cosine = self.vectors(np.stack([grams(texts[i]) for i in at])) @ self.centroids.T
            best = cosine.argmax(axis=1)
            names[at] = np.array(self.languages, object)[self.owner[best]]
            score[at] = np.clip(cosine[np.arange(len(at)), best], 0, 1)
            reject[at] = score[at] < self.floor[self.owner[best]]
        return names.tolist(), score, reject


def cluster(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Unit centroids by spherical k-means, started from the first vector and then the one least like those before."""
    chosen = [x[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(x[np.argmin((x @ np.stack(chosen).T).max(axis=1))])
    c = np.stack(chosen)
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit_rows(rows: list[tuple[str, np.ndarray]], k: int = CENTROIDS) -> Model:
    """rows: language and n-gram counts."""
    if not rows:
        empty = np.zeros((0, 1 << BITS), np.float32)
        return Model([], np.ones(1 << BITS, np.float32), empty, np.zeros(0, np.int64), np.zeros(0))
    counts = np.stack([c for _, c in rows])
    languages = sorted({name for name, _ in rows})
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(languages, idf, counts[:0], np.zeros(0, np.int64), np.zeros(len(languages)))
    x, of = model.vectors(counts), np.array([languages.index(name) for name, _ in rows])
    parts = [cluster(x[of == i], k) for i in range(len(languages))]
    model.centroids, model.owner = np.concatenate(parts), np.repeat(np.arange(len(languages)), [len(p) for p in parts])
    model.floor = np.array([REJECT_SHARE * np.quantile((x[of == i] @ parts[i].T).max(axis=1), REJECT_QUANTILE) for i in range(len(languages))])
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is never learned from: the CRC32 of its id as text leaves 1 modulo 3; false for null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def level(counts: list[int], per_language: int, most: int) -> float:
    """The texts that a language may give at most, so that all of them together give about `most`."""
    share, left = float(per_language), most
    for i, n in enumerate(sorted(counts)):
        share = min(per_language, left / (len(counts) - i))
        if n >= share:
            break
        left -= n
    return share


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, most: int = MOST) -> Model:
    """A model from a bounded sample of the labelled documents that aren't held out."""
    prepare(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"))
    totals = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most)
    counts = {r["lang"]: r["count"] for r in totals.collect()}
    if not counts:
        return fit_rows([])
    share = level(list(counts.values()), per_language, most)
    rates = {k: min(1.0, share / n) for k, n in counts.items()}
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])[F.col("lang")]
    spread = F.xxhash64("doc_id", F.lit(7))
    place = (spread.cast("double") / 2.0**64 + 0.5) / rate  # of the language's sample, alike for all languages
    chosen = labelled.where(place < 1)

    @pandas_udf("binary")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([grams(t).astype(np.float32).tobytes() if has_letter(t) else None for t in batch], dtype=object)

    rows = chosen.select("lang", place.alias("place"), spread.alias("h"), "doc_id", counted(text_or_empty("text")).alias("v")).where("v is not null").orderBy("place", "h", "doc_id", "lang", "v").limit(most).collect()
    rows.sort(key=lambda r: (r["h"], r["doc_id"], r["lang"], r["v"]))
    return fit_rows([(r["lang"], np.frombuffer(r["v"], np.float32)) for r in rows])


def judge(docs: DataFrame, model: Model, to: str, text: str = "text") -> DataFrame:
    """docs with the struct column `to` of lang, score and rejected."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages and CENTROIDS

    @pandas_udf("struct<lang:string,score:double,rejected:boolean>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, score, reject = shared.value.predict(batch.tolist())
            yield pd.DataFrame({"lang": names, "score": score, "rejected": reject})

    return docs.withColumn(to, predict(text_or_empty(text)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected, which replace columns of these names."""
    to = fresh(docs, "__kw_lang")
    out = judge(docs, model, to, text)
    return out.withColumns({"lang_pred": F.col(f"{to}.lang"), "score": F.col(f"{to}.score"), "rejected": F.col(f"{to}.rejected")}).drop(to)
