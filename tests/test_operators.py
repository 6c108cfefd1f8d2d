import math

import pytest
from pyspark.sql import functions as F

from kinweave.config import Settings
from kinweave.operators import audit, blocking, decision, dense, features, fusion, metrics, models, pairs
from kinweave.plans import views
from kinweave.plans.catalog import QUERIES
from kinweave.streaming.topk import TopK, merge


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


REC = "id string, bucket string, seq long, name_core string, addr_postal string, addr_house_number string, text string"


def rec(spark, rows):
    return df(spark, [(i, "us", n, name, postal, house, name) for n, (i, name, postal, house) in enumerate(rows)], REC)


def ids(frame, order="rank"):
    return [r["cand_id"] for r in frame.orderBy("ref_id", order).collect()]


def test_exact_channel(spark):
    pool = rec(spark, [("c0", "acme corp", "10001", "1"), ("c1", "acme corp", "20002", "2"), ("c2", "acme corp", "", "")])
    ask = lambda postal, house, name="acme corp": blocking.exact_channel(rec(spark, [("q", name, postal, house)]), pool)
    assert ids(ask("10001", "1")) == ["c0"] and ids(ask("", "2")) == ["c1"] and ids(ask("", "")) == ["c0", "c1", "c2"] and ids(ask("", "", "globex")) == []
    same = rec(spark, [(f"c{i}", "x", "", "") for i in range(5)])
    assert ids(blocking.exact_channel(rec(spark, [("q", "x", "", "")]), same, cap=2)) == ["c0", "c1"]


def test_sparse_channels(spark):
    s = Settings(word_min_df=1, word_max_df=1.0, char_min_df=1, char_max_df=1.0)
    pool = rec(spark, [("c0", "acme corporation", "", ""), ("c1", "globex corporation", "", ""), ("c2", "acme limited", "", "")])
    found = ids(blocking.word_channel(rec(spark, [("q", "acme", "", "")]), pool, s))
    assert set(found) == {"c0", "c2"}
    pool = rec(spark, [("c0", "acme corporation", "", ""), ("c1", "globex corporation", "", ""), ("c2", "totally different", "", "")])
    assert ids(blocking.char_channel(rec(spark, [("q", "acme corporaton", "", "")]), pool, s, k=1)) == ["c0"]
    capped = blocking.sparse_channel(rec(spark, [("q", "a", "", "")]).withColumn("terms", F.array(F.lit("aa"))), rec(spark, [(f"c{i}", "x", "", "") for i in range(9)]).withColumn("terms", F.array(F.lit("aa"))), min_df=1, max_df=1.0, scan=3)
    assert ids(capped) == ["c0", "c1", "c2"]


def test_phonetic_tiers(spark):
    rows = lambda x: df(spark, [(i, "us", n, name, addr, postal) for n, (i, name, addr, postal) in enumerate(x)], "id string, bucket string, seq long, name_raw string, addr_norm string, addr_postal string")
    pool = blocking.phonetic_columns(rows([("c0", "Acme Private Limited", "ellis hill austin", "1"), ("c1", "Acme", "other place far", ""), ("c2", "Akme", "", ""), ("c3", "Globex", "ellis hill austin", "")]), address="addr_norm")
    found = blocking.phonetic_channel(blocking.phonetic_columns(rows([("q", "Acme Ltd", "ellis hill austin", "1")]), address="addr_norm"), pool)
    score = {r["cand_id"]: r["score"] for r in found.collect()}
    assert score["c0"] >= 4.0 and 3.0 <= score["c1"] < 4.0 and score["c2"] >= 2.0 and score["c3"] >= 1.5
    assert pool.where("id = 'c0'").first()["core"] == "acme"


def test_dense_channels(spark):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8)).round(3)
    rows = lambda keep: df(spark, [(f"v{i}", "b" if i % 2 else "a", i, v[i].tolist()) for i in range(300) if keep(i)] + [("n", "a", 999, None)], "id string, bucket string, seq long, v array<double>")
    refs, cands = rows(lambda i: i % 3 == 0), rows(lambda i: i % 3)
    got = {(x["ref_id"], x["rank"]): x["cand_id"] for x in dense.exact_knn(refs, cands, 5).collect()}
    for q in range(0, 300, 3):
        pool = [i for i in range(300) if i % 3 and i % 2 == q % 2]
        best = sorted(pool, key=lambda i: (-round(float(v[q] @ v[i]), 5), i))[:5]
        assert [got[f"v{q}", k + 1] for k in range(5)] == [f"v{i}" for i in best]
    near = {(x["ref_id"], x["cand_id"]) for x in dense.ivf_knn(refs, cands, 5, cells=6, probes=4).collect()}
    assert len(near & {(q, c) for (q, _), c in got.items()}) / len(got) >= 0.8


def test_registered_cells_keep_the_neighbours(spark):
    d = "/root/testdata/sf0.01"
    want = dense.exact_knn(*views.vectors(spark, d), k=10)
    held = want.join(QUERIES["block_dense_ivf"](spark, d), ["ref_id", "cand_id"], "left_semi")
    assert held.count() / want.count() >= 0.9


def test_registered_features_vary(spark):
    """Sampled pairs aren't only those of equal names, and carry the signals of their channels."""
    rows = QUERIES["features_all"](spark, "/root/testdata/sf0.001")
    assert {r["neg_type"] for r in rows.select("neg_type").distinct().collect()} == {"pos", "hard", "easy"}
    found = rows.agg(*[F.count_distinct(c).alias(c) for c in features.NAMES]).first().asDict()
    for name in ("name_ratio", "name_jaro_winkler", "name_phonetic_jaccard", "name_idf_overlap", "ret_exact_key_hit", "ret_rrf_score", "ret_retriever_agreement", "ret_phon_score"):
        assert found[name] > 1, name


LIST = "ref_id string, channel string, cand_id string, rank int"


def test_rrf(spark):
    one = df(spark, [("r", "A", "x", 1), ("r", "A", "a", 2), ("r", "C", "y", 1), ("r", "C", "x", 2)], LIST)
    assert ids(fusion.rrf(one)) == ["x", "y", "a"]
    two = df(spark, [("r", "A", "b", 1), ("r", "C", "a", 1)], LIST)
    assert ids(fusion.rrf(two)) == ["a", "b"]
    assert ids(fusion.rrf(df(spark, [("r", "A", "x", 1), ("r", "C", "y", 1)], LIST), weights={"A": 2, "C": 0})) == ["x"]
    assert ids(fusion.rrf_extra(fusion.rrf(one), df(spark, [("r", "E", "a", 1)], LIST)))[0] == "a"


def test_coarse_and_truncate(spark):
    fused = df(spark, [("r", "a", 0.9, 1), ("r", "b", 0.8, 2), ("r", "c", 0.1, 3)], "ref_id string, cand_id string, score double, rank int")
    lists = df(spark, [("r", "exact", "b", 1), ("r", "C", "b", 1), ("r", "C", "a", 2)], LIST)
    assert ids(fusion.coarse(fused, lists, 2))[0] == "b"
    score = lambda *s: df(spark, [("r", c, x, n + 1) for n, (c, x) in enumerate(zip("xyz", s, strict=True))], "ref_id string, cand_id string, score double, rank int")
    cut = lambda s, *a: ids(fusion.truncate(score(*s), *a))
    assert cut((1.0, 0.6, 0.2), 0.5, 1, 9) == ["x", "y"] and cut((1.0, 0.6, 0.2), 0.8, 1, 9) == ["x"]
    assert cut((1.0, 0.9, 0.8), 0.95, 2, 9) == ["x", "y"] and cut((1.0, 0.9, 0.8), 0.1, 1, 2) == ["x", "y"] and cut((1.0, 0.9, 0.8), 0.1, 3, 2) == ["x", "y", "z"] and cut((0.0, 0.0, 0.0), 0.9, 1, 9) == ["x", "y", "z"]


PAIR = "ref_id string, cand_id string"


def refs_of(spark, *names):
    return df(spark, [(n, "us") for n in names], "ref_id string, bucket string")


@pytest.mark.parametrize(("truth", "pred", "want"), [
    ([("1", "a"), ("1", "b")], [("1", "a"), ("1", "b")], 1.0), ([], [], 1.0), ([], [("1", "a")], 0.0), ([("1", "a"), ("1", "b")], [("1", "a"), ("1", "c"), ("1", "b")], 0.7142857),
])
def test_macro_f05(spark, truth, pred, want):
    got = metrics.macro_f05(refs_of(spark, "1"), df(spark, truth, PAIR), df(spark, pred + pred, PAIR)).first()
    assert math.isclose(got["macro_f05"], want, abs_tol=1e-6)


def test_macro_f05_of_singletons(spark):
    got = metrics.macro_f05(refs_of(spark, "1", "2", "3"), df(spark, [("3", "x")], PAIR), df(spark, [("2", "y"), ("3", "x")], PAIR)).first()
    assert math.isclose(got["macro_f05"], 2 / 3) and got["singleton_f05"] == 0.5 and got["match_f05"] == 1.0


def test_recall(spark):
    refs, truth = refs_of(spark, "1", "2", "3"), df(spark, [("1", "a"), ("1", "b"), ("2", "q")], PAIR)
    lists = df(spark, [("1", "A", "a", 1), ("1", "A", "x", 2), ("2", "A", "y", 1), ("3", "A", "z", 1)], LIST)
    s = metrics.channel_stats(refs, truth, lists).first()
    assert (s["pairs"], s["hits"], s["any_hit_rate"], s["singleton_rate"]) == (3, 1, 0.5, 1.0) and math.isclose(s["micro_recall"], 1 / 3)
    u = metrics.union_stats(refs_of(spark, "1"), df(spark, [("1", "a"), ("1", "b")], PAIR), df(spark, [("1", "A", "a", 1), ("1", "C", "b", 1)], LIST)).first()
    assert u["micro_recall"] == 1.0 and u["avg_cands"] == 2.0
    ranked = df(spark, [("1", "X", 1), ("1", "Y", 2), ("1", "a", 3), ("2", "b", 1)], "ref_id string, cand_id string, rank int")
    at = {r["n"]: r["recall"] for r in metrics.recall_at(ranked, df(spark, [("1", "a"), ("2", "b")], PAIR), (1, 3)).collect()}
    assert at == {1: 0.5, 3: 1.0}


def test_scores_metrics(spark):
    score = lambda rows: df(spark, rows, "prob double, label int")
    assert metrics.brier_and_log_loss(score([(1.0, 1), (0.0, 0)])).first()["brier"] == 0.0
    half = metrics.brier_and_log_loss(score([(0.5, 1), (0.5, 0)])).first()
    assert half["brier"] == 0.25 and math.isclose(half["log_loss"], 0.693147, abs_tol=1e-6)
    assert metrics.ece(score([(0.0, 0), (1.0, 1)])).first()["ece"] == 0.0
    assert math.isclose(metrics.auc(score([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)])).first()["auc"], 0.75)
    assert metrics.auc(score([(0.5, 0), (0.5, 1)])).first()["auc"] == 0.5


def test_pair_sampling(spark):
    refs = refs_of(spark, "1", "2")
    ranked = df(spark, [("1", c, n + 1) for n, c in enumerate(["a", "x", "y", "z"])] + [("2", "u", 1), ("2", "v", 2)], "ref_id string, cand_id string, rank int")
    truth, pool = df(spark, [("1", "a")], PAIR), pairs.easy_pool(df(spark, [(f"p{i}", "us") for i in range(20)] + [("x", "us"), ("a", "us")], "cand_id string, bucket string"))
    got = pairs.sample_pairs(refs, ranked, truth, pool).collect()
    of = lambda r, t: [x["cand_id"] for x in got if x["ref_id"] == r and x["neg_type"] == t]
    assert of("1", "pos") == ["a"] and sorted(of("1", "hard")) == ["x", "y", "z"] and len(of("1", "easy")) == 2
    assert of("2", "pos") == [] and sorted(of("2", "hard")) == ["u", "v"] and len(of("2", "easy")) == 2
    assert not set(of("1", "easy")) & {"a", "x"} and all(x["rank"] == -1 for x in got if x["neg_type"] == "easy")
    assert {x["rank"] for x in got if x["cand_id"] == "a"} == {0}


def test_splits_and_folds(spark):
    refs = refs_of(spark, *map(str, range(100)))
    s = pairs.split(refs)
    assert s.where("split = 'val'").count() == 20
    assert pairs.folds(refs.union(refs)).groupBy("ref_id").agg(F.count_distinct("fold").alias("n")).where("n > 1").isEmpty()
    assert pairs.sample_references(refs, 7).count() == 7


def full(spark, rows):
    from kinweave.operators.normalise import normalise

    out = normalise(df(spark, rows, "entity_id string, business_name string, business_address string, country string"))
    return features.with_weights(out, features.idf_table(out), out.count())


def test_features(spark):
    recs = full(spark, [("S1-1", "acme corporation", "100 main street springfield il 62704", "us"), ("S2-1", "acme corporation", "100 main street springfield il 62704", "us"), ("S2-2", "globex limited", "55 oak avenue boston ma 02108", "us")])
    rows = {r["cand_id"]: r for r in features.features(df(spark, [("S1-1", "S2-1", 2, 0.5), ("S1-1", "S2-2", -1, None)], PAIR + ", rank int, rrf_score double"), recs).collect()}
    same, other = rows["S2-1"], rows["S2-2"]
    assert len(features.NAMES) == 45 and all(n in same.asDict() for n in features.NAMES)
    for n in ("name_ratio", "name_jaro_winkler", "name_char3_jaccard", "name_token_jaccard", "addr_house_exact", "addr_postal_exact", "addr_city_exact", "addr_state_match", "ret_exact_key_hit", "name_idf_overlap", "struct_same_country"):
        assert same[n] == 1.0, n
    assert other["name_ratio"] < 0.6 and other["addr_digit_conflict"] == 1.0 and other["addr_postal_exact"] == 0.0
    assert (other["ret_candidate_rank"], other["ret_retrieved"], other["ret_rank_inverse"], other["ret_rrf_score"]) == (-1, 0, 0, 0)
    assert math.isclose(same["ret_rank_inverse"], 1 / 3, abs_tol=1e-6)
    assert features.missing_records(df(spark, [("S1-1", "S9-1")], PAIR), recs).first().asDict() == {"no_ref": 0, "no_cand": 1}


SCORE = "ref_id string, cand_id string, prob double"


def decided(spark, probs, open_=False, **k):
    refs = df(spark, [("r", open_)], "ref_id string, is_open boolean")
    return sorted(r["prob"] for r in decision.decide(df(spark, [("r", f"c{i}", p) for i, p in enumerate(probs)], SCORE), refs, **k).collect())


def test_decision_rule(spark):
    assert decided(spark, [0.25, 0.20], tau_s=0.5) == [] and decided(spark, [0.90, 0.87, 0.40], tau_match=0.5, tau_s=0.3, margin=0.05) == [0.87, 0.90]
    assert decided(spark, [0.90, 0.60], tau_match=0.8, margin=0.5) == [0.90] and decided(spark, []) == []
    assert decided(spark, [0.45], True, tau_match=0.2, tau_s=0.3, boost=0.0, veto=0.5) == [] and decided(spark, [0.55], True, tau_s=0.5, boost=0.1, veto=0.5) == []


def test_tuning_agrees_with_the_rule(spark):
    scores = df(spark, [("1", "a", 0.6), ("1", "b", 0.58), ("2", "c", 0.4), ("3", "d", 0.9), ("3", "e", 0.3)], SCORE)
    refs, truth = refs_of(spark, "1", "2", "3", "4"), df(spark, [("1", "a"), ("3", "d")], PAIR)
    s = Settings(tau_match_grid=(0.2, 0.5, 0.8), tau_s_grid=(0.1, 0.5))
    for r in decision.decide_grid(scores, refs, truth, s).collect():
        kept = decision.decide(scores, refs.withColumn("is_open", F.lit(False)), r["tau_match"], r["tau_s"], s.margin)
        assert math.isclose(metrics.macro_f05(refs, truth, kept).first()["macro_f05"], r["macro_f05"])
    assert decision.tune(scores, refs, truth, s)[2] == max(r["macro_f05"] for r in decision.decide_grid(scores, refs, truth, s).collect())


def test_expected_rule(spark):
    def run(probs, open_=False, hat=0.8, floor=0.0, veto=0.5):
        refs = df(spark, [("r", open_)], "ref_id string, is_open boolean")
        return [r["cand_id"] for r in decision.decide_expected(df(spark, [("r", c, p) for c, p in zip("abc", probs, strict=False)], SCORE), refs, hat, floor, veto).orderBy("cand_id").collect()]

    assert run([0.95, 0.90, 0.05]) == ["a", "b"] and run([0.02, 0.01]) == [] and run([0.4], True) == []
    scores = df(spark, [("1", "a", 0.9), ("1", "b", 0.5), ("2", "c", 0.2), ("3", "d", 0.7)], SCORE)
    refs, truth = refs_of(spark, "1", "2", "3"), df(spark, [("1", "a"), ("3", "d")], PAIR)
    s = Settings(recall_hat_grid=(0.65, 0.9), tau_floor_grid=(0.0, 0.5))
    for r in decision.expected_grid(scores, refs, truth, s).collect():
        kept = decision.decide_expected(scores, refs.withColumn("is_open", F.lit(False)), r["recall_hat"], r["tau_floor"])
        assert math.isclose(metrics.macro_f05(refs, truth, kept).first()["macro_f05"], r["macro_f05"])


def test_open_set(spark):
    refs = refs_of(spark, *[f"s{i}" for i in range(10)], *[f"m{i}" for i in range(10)])
    scores = df(spark, [(f"s{i}", "x", 0.55) for i in range(10)] + [(f"m{i}", c, p) for i in range(10) for c, p in (("a", 0.80), ("b", 0.78))], SCORE)
    truth = df(spark, [(f"m{i}", c) for i in range(10) for c in "ab"], PAIR)
    rows = decision.open_set_grid(scores, refs, truth, boosts=(0.0,)).collect()
    best = max(rows, key=lambda r: (r["macro_f05"], -r["veto"]))
    assert best["veto"] == 0.6 and best["macro_f05"] - next(r["macro_f05"] for r in rows if r["veto"] == 0.0) > 0.3
    tops = df(spark, [(str(i), "us", p) for i, p in enumerate((0.10, 0.20, 0.45, 0.55, 0.90))], "ref_id string, bucket string, peak double")
    assert [r["vetoed"] for r in decision.veto_impact(tops, (0.0, 0.5, 0.95)).orderBy("threshold").collect()] == [0, 3, 5]
    assert decision.score_quantiles(tops.where("peak < 0.5").unionByName(df(spark, [("9", "us", 0.3)], tops.schema)).withColumn("peak", F.expr("case ref_id when '0' then 0.1 when '1' then 0.2 when '2' then 0.3 else 0.4 end"))).first()["q50"] == 0.25
    assert [r["is_open"] for r in decision.with_open(df(spark, [("1", "us"), ("2", "france"), ("3", "peru")], "ref_id string, bucket string")).orderBy("ref_id").collect()] == [False, True, True]


def test_diagnostics(spark):
    refs = refs_of(spark, "1", "2", "3", "4", "5")
    truth, pred = df(spark, [("3", "S2-1"), ("4", "S2-1"), ("5", "S2-1"), ("5", "S3-1")], PAIR), df(spark, [("2", "S2-1"), ("4", "S2-1"), ("5", "S2-1"), ("5", "S2-2")], PAIR)
    rows = {r["ref_id"]: r for r in audit.error_classes(refs, truth, pred).collect()}
    assert [rows[str(i)]["error_class"] for i in range(1, 6)] == ["true_singleton", "false_positive", "miss", "exact", "partial"]
    assert math.isclose(rows["5"]["f05"], 1.25 * 0.25 / (0.25 * 0.5 + 0.5)) and rows["5"]["gt_source"] == "s2+s3" and rows["3"]["pred_source"] == "none"
    totals, head = audit.spot_check(refs_of(spark, "a", "b", "c"), df(spark, [("a", "x"), ("c", "y"), ("c", "z")], PAIR), df(spark, [("a", "x", 0.4), ("b", "x", 0.2), ("c", "y", 0.9)], SCORE), 2)
    assert totals.first()["non_empty"] == 2 and totals.first()["mean_pred"] == 1.0 and [r["ref_id"] for r in head.collect()] == ["c", "a"]


def test_guards(spark):
    refs, found = refs_of(spark, "1", "2"), df(spark, [("1", "x")], PAIR)
    with pytest.raises(ValueError, match="missing"):
        audit.check_coverage(refs, found)
    audit.check_coverage(refs_of(spark, "1"), found)
    with pytest.raises(ValueError, match="scope"):
        audit.check_coverage(refs_of(spark, "1"), found.union(df(spark, [("9", "x")], PAIR)))
    with pytest.raises(ValueError):
        features.guard_keys(found, df(spark, [("1", "y")], PAIR), ["ref_id", "cand_id"])


def test_models(spark):
    import random

    r = random.Random(0)
    rows = []
    for i in range(400):
        y = i % 2
        rows.append((f"r{i // 4}", f"c{i}", y, y + r.gauss(0, 0.5), r.gauss(0, 1)))
    data = df(spark, rows, "ref_id string, cand_id string, label int, f1 double, f2 double")
    stack, scored = models.fit_stack(data, ["f1", "f2"], kinds=("forest", "logistic"), n=2, rounds=3)
    assert scored.count() == 400 and metrics.auc(scored.withColumn("prob", F.col("oof_prob"))).first()["auc"] > 0.85
    assert metrics.auc(stack.score(data)).first()["auc"] > 0.85
    cal = models.calibrate_out_of_fold(scored, n=2)
    assert cal.where("calibrated_prob < 0 or calibrated_prob > 1").isEmpty()
    assert models.adopt_calibration(0.02, 0.01, 0.8, 0.8) and not models.adopt_calibration(0.02, 0.018, 0.8, 0.8) and not models.adopt_calibration(0.02, 0.01, 0.8, 0.7)
    one = df(spark, [(x,) for x in (0.0, 0.2, 0.45, 1.0)], "p double").select(models.apply_knots(F.col("p"), [(0.1, 0.0), (0.3, 0.2), (0.6, 0.8)]).alias("y"))
    assert [round(x["y"], 9) for x in one.collect()] == [0.0, 0.1, 0.5, 0.8]
    clean = models.finite(df(spark, [(float("nan"),), (float("inf"),), (-float("inf"),), (None,)], "x double"), ["x"])
    assert [x["x"] for x in clean.collect()] == [0.0, 1.0, 0.0, 0.0]


def test_streaming_top_k(spark, tmp_path):
    rows = [("r", "a", 0.5), ("r", "b", 0.7), ("r", "c", 0.6), ("q", "x", 0.1), ("r", "a", 0.9), ("r", "d", 0.6)]
    whole = df(spark, rows, "ref_id string, cand_id string, score double")
    for i in range(3):
        whole.where(F.lit(True)).limit(2 * i + 2).exceptAll(whole.limit(2 * i)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = TopK(spark, str(tmp_path / "state"), 2)
    q = state.start(spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "log"))
    q.processAllAvailable()
    last = q.lastProgress["batchId"]
    q.stop()
    versions = [int(p.name.split("=")[1]) for p in (tmp_path / "state" / "manifest").iterdir()]
    got = sorted((r["ref_id"], r["cand_id"], r["score"]) for r in state.current(max(versions)).collect())
    assert got == sorted((r["ref_id"], r["cand_id"], r["score"]) for r in merge(None, whole, 2).collect()) and last >= 0


def test_streaming_rewrites_what_a_batch_touches(spark, tmp_path):
    """Only the parts of a batch's references are written, a repeated batch changes nothing, and old versions go."""
    state = TopK(spark, str(tmp_path), 2, parts=8)
    batches = [[(f"r{i}", f"c{n}", float((i * 7 + n) % 5)) for i in range(n, 40, n + 1)] for n in range(5)]
    schema = "ref_id string, cand_id string, score double"
    for n, rows in enumerate(batches):
        state.add(df(spark, rows, schema), n)
    one = [("r1", "z", 9.0)]
    state.add(df(spark, one, schema), 5)
    assert len(list((tmp_path / "rows" / "version=5").glob("part=*"))) == 1
    state.add(df(spark, one, schema), 5)
    state.add(df(spark, [], schema), 6)
    want = merge(None, df(spark, sum(batches, []) + one, schema), 2)
    pick = lambda x: sorted((r["ref_id"], r["cand_id"], r["score"], r["rank"]) for r in x.collect())
    assert pick(state.current(6)) == pick(want)
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir()) == ["version=5", "version=6"]
    kept = {(p.parent.name, p.name) for p in (tmp_path / "rows").glob("version=*/part=*")}
    assert len(kept) <= 8 + 1


def test_small_bucket_beside_a_large_one(spark):
    """The pool's size is a bucket's own: in the small one a term of a single candidate counts, in the large one it doesn't."""
    rows = lambda b, n: [(f"{b}{i}", b, i, "", "", "", f"only{i} shared") for i in range(n)]
    pool = df(spark, rows("small", 20) + rows("large", 120), REC).withColumn("terms", F.split("text", " "))
    ask = df(spark, [("q1", "small", 0, "", "", "", "only3"), ("q2", "large", 0, "", "", "", "only3")], REC).withColumn("terms", F.split("text", " "))
    found = {(r["ref_id"], r["cand_id"]) for r in blocking.sparse_channel(ask, pool, small_pool=50).collect()}
    assert found == {("q1", "small3")}
    assert blocking.sparse_channel(ask, pool).count() == 0


def test_exact_channel_against_plain_code(spark):
    import random

    r = random.Random(1)
    rows = [(f"c{i}", r.choice(["a", "b", "c"]), r.choice(["", "1", "2"]), r.choice(["", "7", "8"])) for i in range(120)]
    asked = [(f"q{i}", r.choice(["a", "b", "", "z"]), r.choice(["", "1", "3"]), r.choice(["", "7"])) for i in range(40)]
    got = {}
    for x in blocking.exact_channel(rec(spark, asked), rec(spark, rows), k=5, cap=4).collect():
        got.setdefault(x["ref_id"], []).append((x["rank"], x["cand_id"], x["score"]))
    for q, name, postal, house in asked:
        tiers = [(3, postal, 2), (2, house, 3), (1, "", None)]
        want = []
        for score, part, at in tiers:
            if name and (part or at is None):
                met = [c for c in rows if c[1] == name and (at is None or c[at] == part)][:4]
                if met:
                    want = [(n + 1, c[0], float(score)) for n, c in enumerate(met)]
                    break
        assert sorted(got.get(q, [])) == want


def test_split_at_any_share(spark):
    rows = refs_of(spark, *map(str, range(501)))
    key = pairs.hashed(F.col("ref_id"))
    order = [r["ref_id"] for r in rows.orderBy(key, "ref_id").collect()]
    for share in (0.0, 0.2, 0.5, 1.0):
        got = {r["ref_id"] for r in pairs.split(rows, share).where("split = 'val'").collect()}
        assert got == set(order[: int(501 * share)])
    tied = pairs.split(rows, 0.1, F.lit(5).cast("long"))
    assert sorted(r["ref_id"] for r in tied.where("split = 'val'").collect()) == sorted(map(str, range(501)))[:50]
    assert pairs.split(rows.limit(0)).count() == 0


def test_signals_that_drifted(spark):
    found = df(spark, [("1", "x"), ("2", "y")], PAIR)
    signals = df(spark, [("1", "x", 0.5), ("2", "y", 0.7), ("3", "z", 0.1)], PAIR + ", s double")
    assert sorted(r["s"] for r in pairs.attach_signals(found, signals, ["s"]).collect()) == [0.5, 0.7]
    with pytest.raises(ValueError, match="lack pairs"):
        pairs.attach_signals(found, signals.where("ref_id != '2'"), ["s"])
    with pytest.raises(ValueError, match="twice"):
        pairs.attach_signals(found, signals.unionByName(signals), ["s"])


def test_artifacts(spark, tmp_path):
    table = refs_of(spark, *map(str, range(10)))
    table.write.parquet(str(tmp_path / "us"))
    table.limit(3).write.parquet(str(tmp_path / "india"))
    places = {b: str(tmp_path / b) for b in ("us", "india", "france", "peru")}
    plan = {"us": 10, "india": 10, "france": 5, "peru": 0}
    with pytest.raises(ValueError, match="india: truncated, 3 of 10.*france: missing"):
        audit.check_artifacts(spark, places, plan)
    sampled = audit.planned_counts(table.withColumn("bucket", F.lit("us")), {"max_refs": 3, "per_bucket": {"us": 3, "india": 3}})
    assert sampled == {"us": 3, "india": 3} and audit.planned_counts(table.withColumn("bucket", F.lit("us")), {"per_bucket": {"us": 3}}) == {"us": 10}
    found = audit.check_artifacts(spark, places, plan | sampled, allow_missing=True)
    assert {b: x["state"] for b, x in found.items()} == {"us": "present", "india": "present", "france": "missing", "peru": "out of scope"}


def test_open_set_choice(spark):
    grid = df(spark, [("us", 0.0, 0.0, 0.5), ("us", 0.1, 0.5, 0.6), ("us", 0.2, 0.5, 0.6), ("india", 0.0, 0.0, 0.9), ("india", 0.1, 0.5, 0.8)], "held string, boost double, veto double, macro_f05 double")
    best = decision.choose_open_set(grid)
    assert (best["us"]["boost"], best["us"]["improvement"]) == (0.1, 0.0) and best["india"]["boost"] == 0.0 and math.isclose(best["india"]["improvement"], 0.1)


def test_choice_of_calibration(spark):
    assert models.choose_calibration({"none": (0.05, 0.8), "global": (0.02, 0.8), "per_bucket": (0.01, 0.7)}) == "global"
    assert models.choose_calibration({"none": (0.01, 0.8), "global": (0.008, 0.9)}) == "none"
    rows = df(spark, [("a",)] * 20 + [("b",)] * 19, "bucket string")
    assert models.calibration_sizes(rows) == ["a"]
    points = [(0.1, 0.0), (0.3, 0.2), (0.3, 0.4), (0.6, 0.8)]
    x = df(spark, [(v / 50,) for v in range(51)], "p double").select(models.apply_knots(F.col("p"), points).alias("a"), models.apply_knots_joined(F.col("p"), points).alias("b"))
    assert all(abs(r["a"] - r["b"]) < 1e-12 for r in x.collect())


def test_tuning_of_fusion(spark):
    refs = df(spark, [("1", "us"), ("2", "fr")], "ref_id string, bucket string")
    lists = df(spark, [("1", "A", "x", 1), ("1", "C", "a", 1), ("1", "C", "x", 30), ("1", "A", "a", 2), ("2", "A", "q", 1)], LIST)
    assert fusion.tune_rrf(lists, df(spark, [("1", "a")], PAIR), refs, 1) == {"us": 10.0, "fr": 10.0}
    best = fusion.weight_sweep(lists, df(spark, [("1", "a")], PAIR), [{"A": 1, "C": 0}, {"A": 0, "C": 1}], 1)
    assert best[0] == ({"A": 0, "C": 1}, 1.0)


def test_tuning_by_bucket(spark):
    refs = df(spark, [("1", "us", False), ("2", "us", False), ("3", "in", False), ("4", "fr", True)], "ref_id string, bucket string, is_open boolean")
    scores = df(spark, [("1", "a", 0.9), ("1", "b", 0.5), ("2", "c", 0.2), ("3", "d", 0.7), ("4", "e", 0.9)], SCORE)
    truth = df(spark, [("1", "a"), ("3", "d")], PAIR)
    s = Settings(recall_hat_grid=(0.65, 0.9), tau_floor_grid=(0.0, 0.5))
    floor, hats, hat = decision.tune_expected(scores, refs, truth, s)
    assert set(hats) == {"us", "in"} and floor in s.tau_floor_grid and hat in s.recall_hat_grid
    got = {(r["ref_id"], r["cand_id"]) for r in decision.decide_expected_by_bucket(scores, refs, floor, hats, hat).collect()}
    assert {("1", "a"), ("3", "d")} <= got


def test_policies(tmp_path):
    p = decision.resolve({"tau_s": 0.4, "veto": None}, {"tau_s": 0.1, "veto": 0.7}, {"margin": 0.2})
    assert (p.tau_s, p.veto, p.margin, p.tau_match) == (0.4, 0.7, 0.2, 0.5)
    p.dump(str(tmp_path / "p.json"))
    import json

    assert decision.resolve(json.load(open(tmp_path / "p.json"))) == p


def test_baselines(spark):
    refs = refs_of(spark, "1", "2")
    rows = {r["baseline"]: r["macro_f05"] for r in metrics.baselines(refs, df(spark, [("1", "a")], PAIR), df(spark, [("1", "A", "a", 1), ("1", "A", "b", 2), ("2", "A", "z", 1)], LIST)).collect()}
    assert rows["all_empty"] == 0.5 and rows["no_singleton_filter"] == 0.5 and math.isclose(rows["all_candidates"], 5 / 9 / 2)
