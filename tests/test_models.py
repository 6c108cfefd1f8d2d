"""The queries that SQL can't express, against plain code or by what they recall."""

import math
import unicodedata
from statistics import median

from pyspark.sql import functions as F

from kinweave.functions import lists
from kinweave.functions import similarity as sim
from kinweave.operators import blocking, dense, models, pairs
from kinweave.plans import views
from kinweave.plans.catalog import QUERIES

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_compressed_vectors_keep_the_neighbours(spark):
    want = dense.exact_knn(*views.vectors(spark, MORE), k=10)
    found = QUERIES["block_dense_compressed"](spark, MORE)
    held = want.join(found, ["ref_id", "cand_id"], "left_semi")
    assert held.count() >= 0.9 * want.count() and found.count() == want.count()


def words(spark):
    return {r["entity_id"]: r for r in views.records(spark, SF).collect()}


def test_metaphone_codes(spark):
    rec = words(spark)
    for r in QUERIES["metaphone_codes"](spark, SF).collect():
        codes = []
        for w in rec[r["entity_id"]]["toks"]:
            c = sim.metaphone(w) if len(w) >= 3 and w.isalpha() else ""
            if c and c not in codes:
                codes.append(c)
        assert r["codes"] == " ".join(codes)
    known = {"school": "SKL", "xerxes": "SRKSS", "philosophy": "FLSF", "thumb": "0M", "judge": "JJ", "church": "XRX", "wrack": "RK", "science": "SNS", "Ülrich": "ULRX", "": "", "123": ""}
    assert {w: sim.metaphone(w) for w in known} == known


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) != "Mn")


def test_normalised_records(spark):
    """Every column again by plain code, for the countries that the query mixes."""
    rec = words(spark)
    for r in QUERIES["normalised_records"](spark, SF).collect():
        own, name = rec[r["entity_id"]], rec[r["entity_id"]]["name_core"]
        raw = [" USA ", "India", "FR", "", "U.S.", "Brazil"][own["doc_id"] % 6]
        country = lists.COUNTRY.get(raw.strip().lower(), raw.strip().lower())
        assert (r["country_raw"], r["country_norm"], r["source"]) == (raw, country, r["entity_id"][:2])
        nfkc = unicodedata.normalize("NFKC", name)
        latin = any("A" <= c <= "ɏ" for c in nfkc)
        assert r["script_type"] == ("latin" if latin else "other")
        tokens = " ".join(lists.ABBREVIATIONS.get(country, {}).get(w, w) for w in (fold(nfkc) if latin else nfkc).lower().split()).split()
        suffix = next((x for k in range(5, 0, -1) if len(tokens) >= k and (x := " ".join(tokens[-k:])) in lists.LEGAL_SUFFIXES.get(country, [])), "")
        core = tokens[: len(tokens) - len(suffix.split())]
        core = [w for w in core if w not in lists.STOPWORDS] or core
        assert (r["name_norm"], r["name_legal_suffix"], r["name_core"]) == (" ".join(tokens), suffix, " ".join(core))
        addr = unicodedata.normalize("NFKC", own["addr_norm"])
        addr = (fold(addr) if latin else addr).lower().split()
        assert r["addr_norm"] == " ".join(addr)
        assert (r["addr_state"], r["addr_city"] if r["addr_city"] and r["addr_city"] in " ".join(addr) else sim.state_and_city(addr, country)[1]) == sim.state_and_city(addr, country)
        assert r["is_missing_name"] == (not name.strip()) and r["is_missing_postal"] == (r["addr_postal"] == "")


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def slow_ratio(a, b):
    return 2 * slow_lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def slow_partial(a, b):
    """The best ratio of the shorter with any window of the longer that is as long, or shorter at either end."""
    if not a or not b:
        return float(a == b)
    short, long = sorted((a, b), key=len)
    n = len(short)
    best = max(slow_ratio(short, long[max(0, e - n) : min(e, len(long))]) for e in range(1, len(long) + n))
    if len(a) == len(b):
        best = max([best, *(slow_ratio(b, x) for e in range(1, n) for x in (a[:e], a[-e:]))])
    return best


def slow_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 1.0
    one, two = (both + " " + left).strip(), (both + " " + right).strip()
    return max(slow_ratio(one, two), *((slow_ratio(both, one), slow_ratio(both, two)) if both else (0.0,)))


def test_features_all(spark):
    """The similarities that need Python, by slow definitions, on the pairs that models are trained on; and what the rest may be."""
    names = {r["entity_id"]: (r["name_core"], r["addr_norm"]) for r in QUERIES["normalised_records"](spark, SF).select("entity_id", "name_core", "addr_norm").collect()}
    raw = words(spark)
    plain = lambda i: " ".join(w for w in fold(raw[i]["name_core"]).split() if w not in lists.STOPWORDS) or fold(raw[i]["name_core"])
    rows = QUERIES["features_all"](spark, SF).collect()
    assert len(rows) > 100 and {r["neg_type"] for r in rows} == {"pos", "hard", "easy"} and names
    checked = 0
    for r in rows[:120]:
        if "fr" in (raw[r["ref_id"]]["bucket"], raw[r["cand_id"]]["bucket"]):
            continue  # written out by rules of its country
        a, b = plain(r["ref_id"]), plain(r["cand_id"])
        u, v = fold(raw[r["ref_id"]]["addr_norm"]), fold(raw[r["cand_id"]]["addr_norm"])
        for name, want in (("name_ratio", slow_ratio(a, b)), ("name_token_sort", slow_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))), ("name_token_set", slow_set(a, b)), ("name_partial_ratio", slow_partial(a, b)), ("addr_partial_ratio", slow_partial(u, v))):
            assert math.isclose(r[name], want, abs_tol=1e-5), (name, a, b)
        checked += 1
    assert checked > 30


def test_block_phonetic(spark):
    """Tiers and coded index again by plain code."""
    rec = views.records(spark, SF)
    refs, cands = (blocking.phonetic_columns(x, "name_core", "addr_norm").collect() for x in views.sides(spark, SF))
    cands = sorted(cands, key=lambda r: r["seq"])
    sizes, df = {}, {}
    for c in cands:
        sizes[c["bucket"]] = sizes.get(c["bucket"], 0) + 1
        for t in set(c["terms"]):
            df[c["bucket"], t] = df.get((c["bucket"], t), 0) + 1
    few = lambda b: sizes[b] < 50
    idf = {(b, t): math.log((1 + sizes[b]) / (1 + n)) + 1 for (b, t), n in df.items() if few(b) or 2 <= n <= 0.03 * sizes[b]}

    def keys(r):
        core, ph, addr, post = (r[x] or "" for x in ("core", "ph", "addr_ph", "addr_postal"))
        found = [(4.0, "ca", core, addr), (3.0, "cp", core, post), (3.0, "c", core), (2.5, "pa", ph, addr), (2.0, "pp", ph, post), (2.0, "p", ph)]
        out = {(k, "|".join(p)): s for s, k, *p in found if all(p)}
        return out | ({("a", addr): 1.5} if len(addr.split()) >= 2 else {})

    held = [(c, keys(c)) for c in cands]
    want = {}
    for r in refs:
        scores = {}
        mine = keys(r)
        for c, theirs in held:
            if c["bucket"] == r["bucket"] and (met := [s for k, s in mine.items() if k in theirs]):
                scores[c["id"]] = max(met)
        w = {t: (1 + math.log(r["terms"].count(t))) * idf[r["bucket"], t] for t in set(r["terms"]) if (r["bucket"], t) in idf}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1
        rare = sorted(w, key=lambda t: (df[r["bucket"], t], t))[:16]
        sparse = {}
        for c in cands:
            if c["bucket"] == r["bucket"] and (s := round(sum(w[t] / norm for t in rare if t in c["terms"]), 9)) > 0:
                sparse[c["id"]] = (s, c["seq"])
        for i, (s, _) in sorted(sparse.items(), key=lambda x: (-x[1][0], x[1][1]))[:50]:
            scores[i] = max(s, scores.get(i, 0.0))
        want[r["id"]] = {i: s for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:50]}
    got = {}
    for x in QUERIES["block_phonetic"](spark, SF).collect():
        got.setdefault(x["ref_id"], {})[x["cand_id"]] = x["score"]
    assert rec.count() == len(refs) + len(cands)
    for i, scores in want.items():
        assert got.get(i, {}).keys() == scores.keys()
        assert all(abs(got[i][c] - s) < 2e-6 for c, s in scores.items())


def test_model_scores(spark):
    """Out-of-fold scores of every sampled pair, that tell true pairs from others."""
    scored = QUERIES["model_scores"](spark, SF)
    rows = scored.collect()
    assert len(rows) == QUERIES["features_all"](spark, SF).count() == len({(r["ref_id"], r["cand_id"]) for r in rows})
    assert all(0 <= r["oof_prob"] <= 1 for r in rows)
    good, bad = ([r["oof_prob"] for r in rows if r["label"] == y] for y in (1, 0))
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.9


def test_folds_side_by_side(spark):
    """Folds are fitted over no more tasks than cores, on rows that are assembled once, and give what each model gives by itself."""
    f = F.col("id")
    df = spark.range(400).repartition(40).select(F.concat(F.lit("S1-"), f % 90).alias("ref_id"), F.concat(F.lit("S2-"), f).alias("cand_id"), (f % 3 == 0).cast("int").alias("label"), F.when(f % 7 > 0, f % 3 + f % 5 / 9).alias("f1"), (f % 11).cast("float").alias("f2"))
    sc = spark.sparkContext
    sc.setJobGroup("side by side", "")
    scored, fitted = models.out_of_fold(df, ["f1", "f2"], n=2, rounds=3)
    sc.setLocalProperty("spark.jobGroup.id", None)
    info = [sc.statusTracker().getStageInfo(s) for j in sc.statusTracker().getJobIdsForGroup("side by side") for s in sc.statusTracker().getJobInfo(j).stageIds]
    assert median(i.numTasks for i in info if i) <= sc.defaultParallelism
    assert scored.columns == [*df.columns, "oof_prob"]
    got = {r["cand_id"]: r for r in scored.collect()}
    own = [r for k in range(2) for r in models.score(fitted[k], pairs.folds(df, 2).where(F.col("fold") == k), ["f1", "f2"]).collect()]
    assert len(got) == len(own) == 400
    for r in own:
        x = got[r["cand_id"]]
        assert abs(x["oof_prob"] - r["prob"]) < 1e-12 and [x[c] for c in df.columns] == [r[c] for c in df.columns]
