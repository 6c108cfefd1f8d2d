import numpy as np

from kinweave.llm import quality


def auc(s, y):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(len(s))
    return (rank[y == 1].mean() - rank[y == 0].mean()) / len(s) + 0.5


def test_against_gold_labels_that_are_never_seen(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 6000")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.score(docs, quality.fit(docs)).join(labels, "doc_id").collect()
    y = np.array([r["quality"] for r in rows])
    assert auc(np.array([r["score"] for r in rows]), y) > 0.97
    assert auc(np.array([r["weak_posterior"] for r in rows]), y) > 0.97
    assert np.mean([r["keep"] for r in rows if r["quality"] == 1]) > 0.97
    assert np.mean([r["keep"] for r in rows if r["quality"] == 0]) < 0.1


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    truth = r.random(20_000) < 0.8
    accuracy = [0.95, 0.8, 0.7, 0.9, 0.85, 0.6, 0.75, 0.9, 0.8]
    cols = [np.where(r.random(len(truth)) < 0.2, "-", np.where((r.random(len(truth)) < a) == truth, "g", "b")) for a in accuracy]
    patterns = ["".join(x) for x in zip(*cols, strict=True)]
    names, n = np.unique(patterns, return_counts=True)
    post = quality.posteriors(dict(zip(names.tolist(), n.tolist(), strict=True)))
    assert np.mean((np.array([post[p] for p in patterns]) > 0.5) == truth) > 0.95


def test_odd_rows(odd_docs, no_docs):
    rows = quality.score(odd_docs, quality.fit(odd_docs)).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and 0 <= r["weak_posterior"] <= 1 for r in rows)
    model = quality.fit(no_docs)
    assert quality.score(no_docs, model).count() == 0 and model.weak == {}
    assert {r["score"] for r in quality.score(odd_docs, model).collect()} == {0.5}


def slow_posteriors(patterns, rounds=quality.ROUNDS):
    """Expectation-maximisation again, pattern by pattern and labeller by labeller."""
    import math

    clip = lambda x, a, b: max(a, min(b, x))
    q = {p: clip((p.count("g") + 1) / (p.count("g") + 3 * p.count("b") + 2), 0.02, 0.98) for p in patterns}
    total = sum(patterns.values())
    for _ in range(rounds):
        share = clip(sum(n * q[p] for p, n in patterns.items()) / total, 0.02, 0.98)
        chance = {}
        for side in (0, 1):
            for k in range(len(quality.LABELLERS)):
                counts = {v: 1.0 + sum(n * (q[p] if side else 1 - q[p]) for p, n in patterns.items() if p[k] == v) for v in "b-g"}
                for v in counts:
                    chance[side, k, v] = math.log(counts[v] / sum(counts.values()))
        log = {(p, side): sum(chance[side, k, v] for k, v in enumerate(p)) for p in patterns for side in (0, 1)}
        q = {p: 1 / (1 + math.exp(clip(log[p, 0] + math.log(1 - share) - log[p, 1] - math.log(share), -30, 30))) for p in patterns}
    return q


def test_against_plain_python(spark):
    """Votes, posteriors, the scorer's training and every score again in plain Python."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs)
    cast = {i: quality.votes(quality.measures(t)) for i, t in rows.items()}
    patterns = {p: list(cast.values()).count(p) for p in set(cast.values())}
    weak = slow_posteriors(patterns)
    assert set(weak) == set(model.weak) and all(abs(weak[p] - model.weak[p]) < 1e-6 for p in weak)
    by_text = {t: weak[cast[i]] for i, t in rows.items()}
    texts = sorted(by_text)  # fewer than the sample takes, so all train once

    def sparse(t):
        m, raw = quality.measures(t), t.encode("utf-8", "replace")
        counts = {}
        for i in range(len(raw) - 2):
            at = int.from_bytes(raw[i : i + 3], "big") * 2654435761 % 2**32 >> 32 - quality.BITS
            counts[at] = counts.get(at, 0) + 1
        v = {k: math.log1p(n) for k, n in counts.items()}
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        v = {k: x / n for k, x in v.items()}
        for k, x in enumerate((m or {}).values()):
            at = (k * 977 + int(min(max(x, 0.0), 8.0) * 20) * 131 + 7) % 2**quality.BITS
            v[at] = v.get(at, 0) + 0.4
        return v

    x = np.zeros((len(texts), 2**quality.BITS))
    for row, t in enumerate(texts):
        for k, n in sparse(t).items():
            x[row, k] = n
    y = np.array([by_text[t] for t in texts])
    weight = np.array([0.5 / y.mean() if v > 0.5 else 0.5 / (1 - y.mean()) for v in y])
    weight /= weight.sum()
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(quality.EPOCHS):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        error = (p - y) * weight
        w, b = w - quality.STEP * (sum(e * r for e, r in zip(error, x, strict=True)) + quality.DECAY * w), b - quality.STEP * error.sum()
    want = dict(zip(texts, 1 / (1 + np.exp(-(x @ w + b))), strict=True))
    for r in quality.score(docs, model).collect():
        assert abs(r["score"] - want[r["text"]]) < 0.02 and abs(r["weak_posterior"] - by_text[r["text"]]) < 1e-6
        assert r["keep"] == (r["score"] >= 0.5)
