import random

import numpy as np

from kinweave.llm import decontaminate as dc


def slow_nearest(p, t):
    best = None
    for a in range(len(t) + 1):
        row = list(range(len(p) + 1))
        for b in range(a, len(t) + 1):
            if b > a:
                new = [row[0] + 1]
                for i in range(1, len(p) + 1):
                    new.append(min(row[i - 1] + (p[i - 1] != t[b - 1]), row[i] + 1, new[-1] + 1))
                row = new
            best = min(best, row[-1]) if best is not None else row[-1]
    return best


def test_nearest_is_exact():
    r = random.Random(4)
    for _ in range(300):
        p, t = [r.randint(0, 3) for _ in range(r.randint(1, 6))], [r.randint(0, 3) for _ in range(r.randint(0, 9))]
        d, a, b = dc.nearest(np.array(p), np.array(t, np.int64))
        assert d == slow_nearest(p, t)
        full = slow_nearest(p, t[a:b])
        assert full == d and b - a <= len(p) + d


def edited(r, words, k):
    words = list(words)
    for _ in range(k):
        i = r.randrange(len(words))
        kind = r.randrange(3)
        words[i : i + 1] = [] if kind == 0 else ["qqq"] if kind == 1 else [words[i], "zzz"]
    return words


def test_recall_of_edited_passages(spark):
    """Planted copies within the tolerance are found; the distance is the least over the whole text by brute force."""
    r = random.Random(6)
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    index = dc.build(items)
    texts, want = [], []
    for n in range(300):
        i, t = r.choice(items)
        words = dc.words_of(t)
        k = [0, 1, len(words) // 10][n % 3]
        host = dc.words_of(r.choice(docs))[:400]
        at = r.randint(0, len(host))
        texts.append(" ".join(host[:at] + edited(r, words, k) + host[at:]))
        want.append((i, k))
    found = dc.match(index, texts)
    hits = [any(m["item_id"] == i and m["distance"] <= k for m in f) for f, (i, k) in zip(found, want, strict=True)]
    assert all(h for h, (_, k) in zip(hits, want, strict=True) if k == 0)
    assert sum(hits) / len(hits) > 0.98
    heavy, total = 0, 0
    for _ in range(100):
        i, t = r.choice(items)
        words = dc.words_of(t)
        text = " ".join(dc.words_of(docs[0])[:200] + edited(r, words, int(0.2 * len(words))) + dc.words_of(docs[1])[:200])
        heavy += any(m["item_id"] == i for m in dc.match(index, [text])[0])
        total += 1
    assert heavy / total >= 0.99


def test_distances_against_brute_force(spark):
    items = [(x["item_id"], x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    docs = [x["text"] for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    index = dc.build(items)
    get = index.vocabulary.get
    for text, found in zip(docs, dc.match(index, docs), strict=True):
        ids = np.array([get(w, 1) for w in dc.words_of(text)], np.int32)
        want = {}
        for item, pattern in index.items:
            d = dc.nearest(pattern, ids)[0] if len(ids) else len(pattern)
            if d <= int(0.2 * len(pattern)):
                want[item] = d
        assert {m["item_id"]: m["distance"] for m in found} == want


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "of señal token the über"), (None, "don't it's l'été"), (2, None), (3, ""), (4, "数据"), (4, "12345 x=1 %%% a_b")], "item_id long, text string")
    rows = dc.find_passages(odd_docs, bench).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        words = " " + " ".join(dc.words_of(r["text"] or "")) + " "
        held = {m["item_id"] for m in r["passages"]}
        exact = " 数 据 " in words or " 12345 x 1 a_b " in words
        assert (4 in held) >= exact and (exact or not held or all(m["char_distance"] is not None for m in r["passages"] if m["item_id"] == 4))
    found = {m["item_id"] for r in rows for m in r["passages"]}
    assert 4 in found and not found & {2, 3}
    assert dc.find_passages(no_docs, bench).count() == 0
    assert all(r["passages"] == [] for r in dc.find_passages(odd_docs, bench.limit(0)).collect())


def test_short_passages_exhaustively():
    r = random.Random(9)
    items = [(i, " ".join(r.choices("abcdef", k=r.randint(1, 11)))) for i in range(60)]
    texts = [" ".join(r.choices("abcdefg", k=r.randint(0, 40))) for _ in range(100)]
    index = dc.build(items)
    for text, found in zip(texts, dc.match(index, texts), strict=True):
        ids = np.array([index.vocabulary.get(w, 1) for w in dc.words_of(text)], np.int32)
        want = {i: d for i, p in index.items if (d := dc.nearest(p, ids)[0]) <= int(0.2 * len(p))}
        assert {m["item_id"]: m["distance"] for m in found} == want


def letters_edited(r, text, k):
    text = list(text)
    for _ in range(k):
        i = r.randrange(len(text))
        text[i : i + 1] = r.choice(([], [r.choice("abcdefghij")], [text[i], r.choice("abcdefghij")]))
    return "".join(text)


def recall(r, items, docs, n, change, planted):
    """The share of passages of n words, changed and planted in documents, that are found."""
    cut = [x[a : a + n] for x in items if len(x) >= n for a in [r.randint(0, len(x) - n)]]
    index = dc.build([(i, " ".join(x)) for i, x in enumerate(cut)])
    texts, want = [], []
    for i in range(planted):
        host = r.choice(docs)[:200]
        at = r.randint(0, len(host))
        texts.append(" ".join([*host[:at], change(cut[i % len(cut)]), *host[at:]]))
        want.append(i % len(cut))
    return sum(any(m["item_id"] == i for m in f) for i, f in zip(want, dc.match(index, texts), strict=True)) / planted


def test_recall_at_every_length(spark):
    """Passages cut to few words, real ones and random ones, planted with all the word edits allowed, and with wrong characters."""
    r = random.Random(12)
    real = [dc.words_of(x["text"]) for x in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    docs = [dc.words_of(x["text"]) for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    every = sorted({w for x in real for w in x})
    made = [r.choices(every, k=60) for _ in range(200)]
    shares = []
    for n in (*range(10, 21), 24, 30, 60):
        for items in (real, made):
            if any(len(x) >= n for x in items):
                shares.append(recall(r, items, docs, n, lambda w: " ".join(edited(r, w, int(0.2 * n))), 100))
                assert shares[-1] >= 0.95, n
                assert recall(r, items, docs, n, lambda w: letters_edited(r, " ".join(w), len(" ".join(w)) // 20), 40) >= 0.9, n
    assert sum(shares) / len(shares) >= 0.99


def test_scripts_without_spaces_and_glued_copies():
    phrase = "人工智能的发展将改变我们学习和工作的方式"
    index = dc.build([(1, phrase), (2, "the quick brown fox jumps over the lazy dog again")])
    texts = ["前面的文字" + phrase + "后面的文字", "前面" + phrase.replace("改变", "影响") + "后", "xthe quick brown fox jumps over the lazy dog againx", "无关的文字" * 20, ""]
    assert [[m["item_id"] for m in f] for f in dc.match(index, texts)] == [[1], [1], [2], [], []]


def test_many_short_items_take_little_memory():
    """16,000 items of six new words: what is held grows with their words, not with items times words."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(6))) for i in range(16_000)]
    index = dc.build(items)
    assert index.member.nbytes + index.bits.nbytes + sum(x.nbytes for x in (*index.keys, *index.windows)) < 30_000_000
    assert [m["item_id"] for m in dc.match(index, ["a " + items[777][1] + " b"])[0]] == [777]


def test_many_blocks_agree(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")

    def pairs():
        return sorted((r["doc_id"], m["item_id"], m["distance"]) for r in dc.find_passages(docs, bench).collect() for m in r["passages"])

    one = pairs()
    monkeypatch.setattr(dc, "BLOCK_CHARS", 1500)
    assert pairs() == one and one
