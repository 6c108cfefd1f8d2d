import random
import re

from kinweave.llm import licenses


def slow(text):
    words = licenses.words_of(text or "")
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


def check(docs):
    want, got = [], []
    for r in docs.collect():
        want.append((r["doc_id"], *slow(r["text"])))
    for r in licenses.scan(docs).collect():
        got.append((r["doc_id"], r["n_words"], sorted((s["first_word"], s["label"]) for s in r["spans"] if s["base"])))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_phrases_by_plain_search(spark, odd_docs, no_docs):
    r = random.Random(7)
    bits = ["cc", "by", "CC", "By", "general", "public", "License", "license", "all", "rights", "Reserved", "é", "K", "x1", "the"]
    rows = [(i, "".join(w + r.choice([" ", "-", ". ", "\n"]) for w in r.choices(bits, k=r.randint(0, 60)))) for i in range(200)]
    rows += [(3, "cc by cc by"), (3, "cc by cc by"), (None, None), (None, "ALL RIGHTS RESERVED. " * 3000)]
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    check(odd_docs)
    assert licenses.scan(no_docs).count() == 0


def test_test_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def spans(spark, text):
    return licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]


def test_edited_license_texts(spark):
    words = licenses.words_of(licenses.TEXTS[0][0])
    host = "one two three ".split() * 30
    edited = words[:9] + ["really"] + words[9:20] + words[21:]
    (s,) = spans(spark, " ".join(host + edited + host))
    assert s["label"] == "mit" and not s["base"] and s["first_word"] == 90 and s["last_word"] == 90 + len(edited) - 1 and 0.6 <= s["share"] < 1
    assert not spans(spark, " ".join(host + words[:12] + host))
    two = spans(spark, " ".join(words + host + words))
    assert [(x["label"], x["share"]) for x in two] == [("mit", 1.0)] * 2
    assert {x["label"] for x in spans(spark, "Licensed under CC BY-NC 4.0.")} == {"cc-by", "cc-by-nc"}


def test_runs_are_few():
    assert licenses.RUNS < 400 and all(re.fullmatch(r"[a-z0-9 ]+", " ".join(w)) for w, _, _ in licenses.TEMPLATES)


def slow_spans(text):
    """Diagonal voting again: every run of every template at every word, by comparing words."""
    words = licenses.words_of(text or "")
    out = []
    for template, label, k in licenses.TEMPLATES:
        votes = {}
        for at in range(len(template) - k + 1):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == template[at : at + k]:
                    votes.setdefault(i - at, set()).add(at)
        groups = []
        for d in sorted(votes):
            if groups and k == licenses.LONG_RUN and d - groups[-1][-1] <= licenses.GAP:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            met = set().union(*(votes[d] for d in g))
            share = len(met) / (len(template) - k + 1)
            if share >= (licenses.COVER if k == licenses.LONG_RUN else 1):
                out.append((label, min(d + min(votes[d]) for d in g), max(d + max(votes[d]) for d in g) + k - 1, round(share, 9)))
    return sorted(out)


def test_all_spans_by_plain_voting(spark):
    r = random.Random(3)
    rows = []
    for i in range(80):
        words = []
        for _ in range(r.randint(0, 3)):
            own = licenses.words_of(r.choice(licenses.TEXTS)[0])
            for _ in range(r.randint(0, 2)):
                at = r.randrange(len(own))
                own[at : at + 1] = r.choice(([], ["qqq"], [own[at], "zzz"]))
            words += own[r.randint(0, 8) :] + r.choices("one two all rights reserved cc by".split(), k=r.randint(0, 9))
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "İ K\u212a ALL RIGHTS RESERVED")], "doc_id long, text string")
    texts = {x["doc_id"]: x["text"] for x in docs.collect()}
    some = 0
    for x in licenses.scan(docs).collect():
        want = slow_spans(texts[x["doc_id"]])
        assert sorted((s["label"], s["first_word"], s["last_word"], round(s["share"], 9)) for s in x["spans"]) == want
        some += any(label not in ("cc-by", "gpl", "reserved") for label, *_ in want)
    assert some > 30


def test_only_ascii_is_lowered(spark):
    """The Kelvin sign isn't a k."""
    (words,) = [x["n_words"] for x in licenses.scan(spark.createDataFrame([(1, "\u212aEY KEY")], "doc_id long, text string")).collect()]
    assert words == 2 and licenses.words_of("\u212aEY KEY") == ["\u212aey", "key"]
