import random

import numpy as np
import xxhash

from kinweave.llm import simhash


def slow_fingerprint(text):
    words = bytes(text or "", "utf-8").lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def slow_components(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expect(rows):
    prints = [slow_fingerprint(t) for _, t in rows]
    comps = slow_components(prints)
    least = {}
    for (i, _), c in zip(rows, comps, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, p, least.get(c)) for (i, _), p, c in zip(rows, prints, comps, strict=True)), key=str)


def got(df):
    return sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in df.collect()), key=str)


def test_against_all_pairs(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(simhash.near_duplicates(odd_docs)) == expect(rows)
    assert simhash.near_duplicates(no_docs).count() == 0


def test_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(simhash.near_duplicates(docs)) == expect([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_links_close_like_all_pairs_with_deep_and_heavy_tries(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "CHUNK", 100)
    r = random.Random(5)
    values = {r.getrandbits(64) for _ in range(150)}
    for base in list(values)[:20]:
        for _ in range(6):
            values.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 5))))
    base = r.getrandbits(64)
    values |= {base ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    values = sorted(values)
    df = spark.createDataFrame([(int(np.array(v, np.uint64).view(np.int64)),) for v in values], "fp long")
    roots = {x["node"] % 2**64: x["root"] % 2**64 for x in simhash.components(simhash.links(df)).collect()}
    comps = slow_components(values)
    for i in range(len(values)):
        for j in range(i):
            same = roots.get(values[i], values[i]) == roots.get(values[j], values[j])
            assert same == (comps[i] == comps[j])


def test_components_of_a_long_path(spark):
    n = 60
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (101, 101)], "u long, v long")
    roots = {r["node"]: r["root"] for r in simhash.components(df).collect()}
    assert roots == {i: 0 for i in range(1, n + 1)} | {101: 100}


def test_keep_one(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = expect(rows)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert sorted(named) == sorted({c for _, _, c in want if c is not None})
    assert ids.count(None) == len({p for i, p, c in want if c is None})
    some = simhash.keep_one(odd_docs, most_broadcast=0)
    assert sorted(map(str, (r["doc_id"] for r in some.collect()))) == sorted(map(str, ids))
