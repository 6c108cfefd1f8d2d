"""Quality scores without gold labels.

Overlapping heuristic labellers vote good, bad or nothing on every text. Expectation-maximisation over the counts of
vote patterns estimates each labeller's accuracies and the share of good texts, with one latent class. The posterior of
a text's pattern is its label; the labels of a bounded sample of texts, chosen by a hash, train a linear scorer of
hashed features, which scores every text.

Defined cases: a null text is empty; a text without words gets no votes and the score that its features give;
repeated texts count as often as they stand in the patterns, train the scorer once and are all scored; texts of any length
count whole; an empty table gives an empty result; other columns are kept, columns named like the outputs are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from kinweave.llm.common import fresh, prepare, text_or_empty

BITS = 12
#: Texts that train the scorer, at most; half of them from either side of the posterior where there are enough.
SAMPLE = 4000
ROUNDS, EPOCHS, STEP, DECAY = 60, 300, 4.0, 1e-4
_space, _letter, _upper, _digit = (np.zeros(256, bool) for _ in range(4))
_space[[9, 10, 11, 12, 13, 32]] = True
_letter[65:91] = _letter[97:123] = _letter[128:] = True
_upper[65:91] = True
_digit[48:58] = True
_closing = re.compile(r"[.!?…\"')\]]\s*$")


def measures(text: str) -> dict[str, float] | None:
    """What the labellers look at; None for a text without words."""
    words = text.split()
    if not words:
        return None
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    seen = max(1, int((~_space[raw]).sum()))
    letters = max(1, int(_letter[raw].sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    return {
        "symbols": 1 - (_letter[raw].sum() + _digit[raw].sum()) / seen,
        "bars": sum(n for w, n in counts.items() if len(w) == 1 and not w.isalnum()) / len(words),
        "capitals": _upper[raw].sum() / letters,
        "top_word": max(counts.values()) / len(words) if len(words) >= 8 else 0.1,
        "variety": len(counts) / len(words) ** 0.9,
        "lines": 1 - len(set(lines)) / len(lines) if len(lines) > 2 else 0.0,
        "digits": _digit[raw].sum() / seen,
        "closed": sum(bool(_closing.search(x)) for x in lines) / len(lines),
        "ends": sum(w[-1] in ".!?,;:" for w in words) / len(words),
        "length": letters / len(words),
    }


#: measure, bad beyond, good within; the second pair is for measures where little is bad.
LABELLERS = (
    ("symbols", 0.12, 0.07, True),
    ("bars", 0.10, 0.02, True),
    ("capitals", 0.35, 0.12, True),
    ("top_word", 0.30, 0.16, True),
    ("lines", 0.30, 0.05, True),
    ("digits", 0.30, 0.10, True),
    ("variety", 0.25, 0.60, False),
    ("closed", 0.30, 0.70, False),
    ("ends", 0.02, 0.06, False),
)


def votes(m: dict[str, float] | None) -> str:
    """A character for each labeller: b, g or - for no vote."""
    if m is None:
        return "-" * len(LABELLERS)
    return "".join("b" if (m[k] > bad if much else m[k] < bad) else "g" if (m[k] < good if much else m[k] > good) else "-" for k, bad, good, much in LABELLERS)


def posteriors(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """The probability that a text with each pattern is good. Started from the share of good votes."""
    if not patterns:
        return {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    cast = np.array([[["b", "-", "g"].index(c) for c in p] for p in names])
    one_hot = np.eye(3)[cast]
    good = (cast == 2).sum(axis=1)
    bad = (cast == 0).sum(axis=1)
    q = np.clip((good + 1) / (good + 3 * bad + 2), 0.02, 0.98)
    for _ in range(rounds):
        share = np.clip((n * q).sum() / n.sum(), 0.02, 0.98)
        table = []
        for w in (n * (1 - q), n * q):
            counts = np.einsum("p,plv->lv", w, one_hot) + 1.0
            table.append(np.log(counts / counts.sum(axis=1, keepdims=True)))
        by = [np.einsum("plv,lv->p", one_hot, t) for t in table]
        q = 1 / (1 + np.exp(np.clip(by[0] + math.log(1 - share) - by[1] - math.log(share), -30, 30)))
    agree = np.corrcoef(q, good - bad)[0, 1] if len(names) > 1 and q.std() > 0 and (good - bad).std() > 0 else 1
    return dict(zip(names, (q if agree >= 0 else 1 - q).tolist(), strict=True))


def features(text: str, m: dict[str, float] | None) -> np.ndarray:
    """Hashed byte 3-grams and binned measures, each part of unit length."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    out = np.zeros(1 << BITS, np.float32)
    if len(raw) > 2:
        codes = ((raw[:-2] << np.uint32(16)) | (raw[1:-1] << np.uint32(8)) | raw[2:]) * np.uint32(2654435761)
        out = np.log1p(np.bincount(codes >> np.uint32(32 - BITS), minlength=1 << BITS)).astype(np.float32)
        out /= np.linalg.norm(out)
    for k, x in enumerate((m or {}).values()):
        out[(k * 977 + int(min(max(x, 0.0), 8.0) * 20) * 131 + 7) % (1 << BITS)] += 0.4
    return out


@dataclass
class Model:
    weak: dict[str, float]
    weights: np.ndarray
    bias: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities as labels, by full gradients; the classes weigh alike."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    if len(x):
        up = max(1e-6, y.mean())
        weight = np.where(y > 0.5, 0.5 / up, 0.5 / max(1e-6, 1 - up)).astype(np.float32)
        weight /= weight.sum()
        for _ in range(epochs):
            error = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y) * weight
            w -= STEP * (x.T @ error + DECAY * w)
            b -= STEP * float(error.sum())
    return w, b


def votes_column(text: str = "text") -> Column:
    @pandas_udf("string")
    def cast(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([votes(measures(t)) for t in batch], dtype=object)

    return cast(text_or_empty(text))


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> Model:
    """Accuracies from the patterns of all texts; the scorer from a sample of them."""
    prepare(docs.sparkSession)
    counts = {r["v"]: r["count"] for r in docs.select(votes_column(text).alias("v")).groupBy("v").count().collect()}  # at most 3**len(LABELLERS) rows
    weak = posteriors(counts)
    sides = [sum(n for p, n in counts.items() if (weak[p] > 0.5) == side) for side in (False, True)]
    rates = [min(1.0, sample / 2 / max(1, n)) for n in sides]
    shared = docs.sparkSession.sparkContext.broadcast(weak)
    most = max(rates)

    @pandas_udf("struct<x:binary,y:double,h:long>")
    def featured(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, spread in batches:
            rows = []
            for t, h in zip(texts, spread, strict=True):
                m = measures(t)
                y = shared.value.get(votes(m), 0.5)
                rows.append((features(t, m).astype(np.float16).tobytes() if h / 2**64 + 0.5 < rates[y > 0.5] else None, y, h))
            yield pd.DataFrame(rows, columns=["x", "y", "h"])

    key = F.xxhash64(text_or_empty(text), F.lit(11))
    chosen = docs.where(key.cast("double") / 2.0**64 + 0.5 < most).select(featured(text_or_empty(text), key).alias("f")).where("f.x is not null")
    rows = chosen.select("f.*").dropDuplicates(["h"]).orderBy("h", "y").limit(2 * sample).collect()
    if not rows:
        return Model(weak, np.zeros(1 << BITS, np.float32), 0.0)
    return Model(weak, *train(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), np.array([r["y"] for r in rows], np.float32)))


def score(docs: DataFrame, model: Model, text: str = "text", keep_from: float = 0.5) -> DataFrame:
    """docs with score, weak_posterior and keep."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("struct<score:double,weak:double>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [measures(t) for t in batch]
            x = np.stack([features(t, m) for t, m in zip(batch, seen, strict=True)]) if len(batch) else np.zeros((0, 1 << BITS), np.float32)
            yield pd.DataFrame({"score": shared.value.scores(x).astype(float), "weak": [shared.value.weak.get(votes(m), 0.5) for m in seen]})

    to = fresh(docs, "__kw_quality")
    out = docs.withColumn(to, of(text_or_empty(text)))
    return out.withColumns({"score": F.col(f"{to}.score"), "weak_posterior": F.col(f"{to}.weak"), "keep": F.col(f"{to}.score") >= keep_from}).drop(to)
