from zlib import crc32

from kinweave.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).withColumn("out", langid.held_out()).collect()
    assert all(r["out"] == (crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    out = [r for r in found if r["out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found)
    assert sum(r["rejected"] for r in found) / len(found) < 0.01


def test_odd_rows(odd_docs, no_docs):
    model = langid.fit(odd_docs)
    assert set(model.languages) <= {"a", "b"}
    rows = langid.identify(odd_docs, model).collect()
    for r in rows:
        lettered = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] in model.languages) == lettered and (lettered or r["lang_pred"] == "und" and r["score"] == 0 and r["rejected"])
    assert langid.identify(no_docs, langid.fit(no_docs)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.fit(no_docs)).collect()} == {"und"}


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "zzz qqq", "x" if crc32(str(i).encode()) % 3 == 1 else "y") for i in range(60)] + [(None, "abc", "z")]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["y"]


def test_rare_languages_stay_in_a_bounded_sample(spark):
    """Twenty languages of 3,000 texts and one of 60: the bound cuts them alike."""
    name = "CASE WHEN id < 60 THEN 'rare' ELSE concat('l', id % 20) END"
    docs = spark.range(60_060).selectExpr("id AS doc_id", f"concat({name}, ' abc def') AS text", f"{name} AS lang")
    assert langid.fit(docs, per_language=40, most=200).languages == sorted(["rare", *(f"l{i}" for i in range(20))])
    assert langid.level([300, *[100_000] * 20], 400, 4000) == 4000 / 21
    assert langid.level([10, 5000], 400, 400) == 390 and langid.level([10, 5000], 400, 4000) == 400


def test_noise_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    assert model.predict(["xq zx qz vkx wqz jjq zzx qkv xjw " * 20])[2][0]


def slow_grams(text):
    """Counts of hashed byte 2- and 3-grams in plain Python."""
    raw = [32] + [b if 97 <= b <= 122 or b >= 128 else 32 for b in text.lower().encode("utf-8", "replace")] + [32]
    counts = {}
    for n in (2, 3):
        for i in range(len(raw) - n + 1):
            if any(b != 32 for b in raw[i : i + n]):
                at = int.from_bytes(bytes(raw[i : i + n]), "big") * 2654435761 % 2**32 >> 20
                counts[at] = counts.get(at, 0) + 1
    return counts


def test_against_plain_python(spark):
    """The whole fit and every prediction again with dictionaries: idf, spherical k-means, cosines and rejection."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in docs.collect()]
    model = langid.fit(docs, per_language=12, most=40)
    hashed = docs.selectExpr("doc_id", "xxhash64(doc_id, 7) AS h").collect()
    place = {r["doc_id"]: r["h"] for r in hashed}
    learned = [(i, la, t) for i, la, t in rows if la is not None and crc32(str(i).encode()) % 3 != 1]
    counts = {la: sum(x == la for _, x, _ in learned) for la in {x for _, x, _ in learned}}
    share = langid.level(list(counts.values()), 12, 40)
    spread = {i: (place[i] / 2.0**64 + 0.5) / min(1.0, share / counts[la]) for i, la, _ in learned}
    lettered = [x for x in learned if any(map(str.isalpha, x[2]))]
    chosen = sorted(sorted((x for x in lettered if spread[x[0]] < 1), key=lambda x: (spread[x[0]], place[x[0]], x[0]))[:40], key=lambda x: (place[x[0]], x[0]))
    vectors = [(la, slow_grams(t)) for _, la, t in chosen]
    idf = {g: math.log((1 + len(vectors)) / (1 + sum(g in v for _, v in vectors))) + 1 for _, v in vectors for g in v}
    rest = math.log(1 + len(vectors)) + 1

    def unit(v):
        n = math.sqrt(sum(x * x for x in v.values())) or 1
        return {k: x / n for k, x in v.items()}

    def weighed(v):
        return unit({g: math.log1p(n) * idf.get(g, rest) for g, n in v.items()})

    def dot(a, b):
        return sum(x * b.get(k, 0) for k, x in a.items())

    def mean(vs):
        return unit({k: sum(v.get(k, 0) for v in vs) for v in vs for k in v})

    cents, floors = [], {}
    for la in sorted(counts):
        xs = [weighed(v) for x, v in vectors if x == la]
        if not xs:
            continue
        c = [xs[0]]
        while len(c) < min(langid.CENTROIDS, len(xs)):
            c.append(min(xs, key=lambda x: max(dot(x, y) for y in c)))
        for _ in range(12):
            near = [max(range(len(c)), key=lambda k: (dot(x, c[k]), -k)) for x in xs]
            c = [mean([x for x, n in zip(xs, near, strict=True) if n == k]) if k in near else c[k] for k in range(len(c))]
        cents += [(la, x) for x in c]
        reach = sorted(max(dot(x, y) for y in c) for x in xs)
        at = langid.REJECT_QUANTILE * (len(reach) - 1)
        low = reach[int(at)] + (at - int(at)) * (reach[min(int(at) + 1, len(reach) - 1)] - reach[int(at)])
        floors[la] = langid.REJECT_SHARE * low
    found = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert model.languages == sorted(floors) and len(cents) == len(model.centroids)
    for i, _, t in rows:
        r = found[i]
        if not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        x = weighed(slow_grams(t))
        by = {la: max(dot(x, c) for name, c in cents if name == la) for la in floors}
        best = max(by.values())
        assert abs(by[r["lang_pred"]] - best) < 1e-4 and abs(r["score"] - best) < 1e-4
        assert r["rejected"] == (best < floors[r["lang_pred"]]) or abs(best - floors[r["lang_pred"]]) < 1e-4
