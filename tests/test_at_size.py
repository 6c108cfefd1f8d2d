"""What larger tables showed: queries against their SQL on small tables made for one case each."""

import os
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinweave.operators import blocking, decision, fusion, metrics, models, packed
from kinweave.plans import catalog, linkage, views
from kinweave.sources import folders

SF = "/root/testdata/sf0.001"


def plain(v):
    return "None" if v is None else repr(float(v)) if isinstance(v, float) else str(v)


def same_as_sql(spark, folder, rows, name):
    """Writes rows (doc_id, text, lang) as the documents of a folder; the query's rows, after they were found to be the SQL's."""
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    found = con.execute(catalog.SQL[name])
    names = [c[0] for c in found.description]
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    return [dict(zip(columns, r, strict=True)) for r in got]


@pytest.mark.parametrize("name", ["normalised_fields", "reference_metadata"])
def test_accents_of_addresses_below_names_without_letters(spark, tmp_path, name):
    rows = [(0, "1 389 555 5010 les éèpaeux arrró", "fr"), (6, "Réseau Hôtel Naïve un deux éèpaeux", "fr"), (1, "12 34 56 78 cioñ", "es"), (12, "1 2 3 4 99", "de")]
    got = same_as_sql(spark, tmp_path, rows, name)
    assert "les eepaeux arrro" in [r["addr_norm"] for r in got]


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^\n]*), \d+\)", df._jdf.queryExecution().executedPlan().toString())


def test_no_row_travels_for_each_pair_that_shares_a_term(spark):
    dealt = exchanges(blocking.word_channel(*views.sides(spark, SF)))
    assert dealt and not [x for x in dealt if "cand_id" in x]


def test_a_channel_list_is_dealt_once_for_fusion(spark):
    assert len(exchanges(fusion.rrf(linkage.stored_lists(spark, SF), 10, top_n=5))) <= 1


def test_a_grid_of_k_deals_no_row_for_each_k_and_candidate(spark):
    lists, truth = linkage.stored_lists(spark, SF), views.truth(spark, SF)
    dealt = exchanges(fusion.rrf_grid(lists, truth, 5))
    assert dealt and not [x for x in dealt if re.search(r"\bk#", x) and "ref_id" in x]


@pytest.mark.parametrize("grid", [decision.decide_grid, decision.expected_grid, decision.open_set_grid])
def test_a_grid_of_rules_deals_no_row_for_each_setting_and_reference(spark, grid):
    dealt = exchanges(grid(linkage.scored_pairs(spark, SF), views.references(spark, SF), views.truth(spark, SF)))
    assert dealt and not [x for x in dealt if re.search(r"\b(tau_|recall_hat|boost|veto)", x) and "ref_id" in x]


def test_references_that_keep_nothing_count_at_every_setting(spark):
    refs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ref_id string")
    truth = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "x"), ("z", "x")], "ref_id string, cand_id string")
    scores = spark.createDataFrame([("a", "x", 0.6), ("a", "x", 0.1), ("c", "y", 0.6), ("z", "x", 0.9), ("d", "y", None)], "ref_id string, cand_id string, prob double")
    got = {(r["boost"], r["veto"]): r["macro_f05"] for r in decision.open_set_grid(scores, refs, truth, vetoes=(0.0, 0.7)).collect()}
    assert got == {(b, v): 0.5 for b in (0.0, 0.1, 0.2) for v in (0.0, 0.7)}  # a and d, then c and d
    assert decision.open_set_grid(scores, refs.limit(0), truth).count() == 0


def test_scores_are_dealt_by_reference_for_a_decision(spark):
    dealt = exchanges(decision.decide(linkage.scored_pairs(spark, SF), views.references(spark, SF).withColumn("is_open", F.lit(False))))
    assert not [x for x in dealt if "cand_id" in x]


def test_texts_do_not_travel_for_the_truth(spark):
    plan = views.truth(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in exchanges(views.truth(spark, SF)) if "text" in x] and "digest" in plan


def test_search_over_many_parts(spark, monkeypatch):
    refs, cands = views.sides(spark, SF)
    want = sorted(map(tuple, blocking.word_channel(refs, cands).collect()))
    monkeypatch.setattr(packed, "PART", 1)
    assert want and sorted(map(tuple, blocking.word_channel(refs, cands).collect())) == want


def test_similarity_of_packed_pairs(spark, monkeypatch):
    monkeypatch.setattr(packed, "SCORED_PART", 1)
    rows = lambda x: spark.createDataFrame([(i, "b", n, t) for n, (i, t) in enumerate(x)], "id string, bucket string, seq long, toks array<string>")
    refs, cands = rows([("r1", ["a", "b", "b"]), ("r2", [])]), rows([("c1", ["b", "c"]), ("c2", []), ("c3", ["a", "b"]), ("c4", ["z"])])
    pairs = spark.createDataFrame([("r1", "c1"), ("r1", "c1"), ("r1", "c3"), ("r1", "c4"), ("r2", "c2"), ("r2", "c1"), ("r1", "c2")], "ref_id string, cand_id string")
    got = sorted(map(tuple, linkage.token_similarity(pairs, refs, cands).collect()))
    assert got == [("r1", "c1", 0.333333), ("r1", "c2", 0.0), ("r1", "c3", 1.0), ("r1", "c4", 0.0), ("r2", "c1", 0.0), ("r2", "c2", 0.0)]


def test_a_struct_as_seq_breaks_ties_as_a_number_does(spark):
    rows = spark.createDataFrame([(f"c{n:02}", "b", n, ["x"]) for n in range(30)], "id string, bucket string, seq long, terms array<string>")
    asked = spark.createDataFrame([("r", "b", 0, ["x"])], "id string, bucket string, seq long, terms array<string>")
    for cands in (rows, rows.withColumn("seq", F.struct(F.lit("S2").alias("source"), "id"))):
        found = blocking.sparse_channel(asked, cands, 7, min_df=1, max_df=1.0, scan=5)
        assert [r["cand_id"] for r in found.orderBy("rank").collect()] == [f"c{n:02}" for n in range(5)]


def test_blocks_hold_every_record_and_term(monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 4)
    monkeypatch.setattr(packed, "TERMS", 9)
    terms = [[f"t{(i * j) % 11}" for j in range(i % 7)] for i in range(60)] + [["t1"] * 40]
    batch = pa.record_batch({"ids": [str(i) for i in range(61)], "seqs": list(range(61)), "bucket": ["ab"[i % 2] for i in range(61)], "terms": pa.array(terms, pa.list_(pa.string()))})
    got = {}
    for out in packed._blocks(iter([batch.slice(0, 33), batch.slice(33)]), pa.int64(), False):
        (row,) = out.to_pylist()
        n, codes, tf = (packed._unzip(row[c], np.int32) for c in ("n", "codes", "tf"))
        assert len(n) <= 4
        starts = packed._starts(n)
        for i, (a, b) in zip(row["ids"], zip(starts, starts[1:], strict=False), strict=True):
            got[int(i)] = sorted(row["terms"][c] for c, m in zip(codes[a:b], tf[a:b], strict=True) for _ in range(m))
    assert got == {i: sorted(t) for i, t in enumerate(terms)}


def test_candidates_and_partial_lists_do_not_travel(spark):
    dealt = exchanges(blocking.word_channel(*views.sides(spark, SF)))
    assert not [x for x in dealt if "ref_id" in x or "part" in x]


def test_pairs_to_be_scored_are_dealt_once(spark):
    pairs = linkage.stored_lists(spark, SF).select("ref_id", "cand_id")
    assert len(exchanges(linkage.token_similarity(pairs, *views.sides(spark, SF)).select("prob"))) <= 2


@pytest.mark.parametrize("limits", [{}, {"HELD": 1, "GATHERED": 5}, {"HELD": 20, "GATHERED": 40, "CELLS": 64}])
def test_search_that_gathers_and_holds_little(spark, monkeypatch, limits):
    held = {n: [f"t{t}" for t in range(12) if (n * 7 + t * t) % 5 < 2] for n in range(90)}
    rows = spark.createDataFrame([(f"c{n}", "b", n, t) for n, t in held.items()], "id string, bucket string, seq long, terms array<string>")
    files = folders.files_by(folders.kept(packed.pack(rows.repartition(6), True), "some"), "bucket")
    weights = {(r, t): (1 + (r * 3 + t) % 4) / 8 for r in range(20) for t in range(12) if (r + t) % 3 == 0}
    n = np.bincount([r for r, _ in weights], minlength=20).astype(np.int32)
    codes, w = np.array([t for _, t in weights], np.int32), np.array(list(weights.values()))
    cut = pa.array([[{"at": 4, "seq": 50}]], pa.list_(pa.struct([("at", pa.int32()), ("seq", pa.int64())])))
    asked = {"bucket": ["b"], "share": [0], "ids": [[f"r{r}" for r in range(20)]], "terms": [[f"t{t}" for t in range(12)]], "cut": cut, "n": [packed._zip(n)], "codes": [packed._zip(codes)], "w": [packed._zip(w)]}
    want = []
    for r in range(20):
        scores = [(-sum(x for (q, t), x in weights.items() if q == r and f"t{t}" in held[c] and (t != 4 or c <= 50)), c) for c in held]
        want += [(f"r{r}", f"c{c}", -x, i + 1) for i, (x, c) in enumerate(sorted(p for p in scores if p[0] < 0)[:7])]
    for name, value in limits.items():
        monkeypatch.setattr(packed, name, value)
    assert [tuple(x.values()) for b in packed._search(iter([pa.record_batch(asked)]), files, 7, pa.int64()) for x in b.to_pylist()] == want


def test_what_a_stored_table_was_made_from_goes(spark, tmp_path):
    made = []

    def build():
        made.append(folders.kept(spark.range(3), "some"))
        return made[0].selectExpr("id + 1 AS id")

    assert sorted(r["id"] for r in folders.stored(spark, "test-of-kept", [str(tmp_path)], build).collect()) == [1, 2, 3]
    assert not folders.exists(spark, made[0].inputFiles()[0].rpartition("/")[0])


def test_rows_of_kept_files_by_value(spark):
    rows = [(i, "a b" if i % 2 else "ü") for i in range(9)]
    df = folders.kept(spark.createDataFrame(rows, "id long, bucket string").repartition(2), "some")
    files = folders.files_by(df, "bucket")
    got = {b: sorted(r.column("id")[0].as_py() for r in folders.rows_of(files[b], ["id"], ("bucket", b))) for b in files}
    assert got == {"a b": [1, 3, 5, 7], "ü": [0, 2, 4, 6, 8]}


def shuffled(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if re.fullmatch(r"shuffle_.*\.data", f)}


@pytest.mark.parametrize("write", ["stored", "kept", "written"])
def test_shuffle_files_go_when_a_shared_table_is_written(spark, tmp_path, write):
    before, rows = shuffled(spark), spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("n"))
    out = folders.stored(spark, "test-of-shuffles", [str(tmp_path)], lambda: rows) if write == "stored" else getattr(folders, write)(rows, "some")
    for _ in range(100):  # executors are told, and not waited for
        if left := shuffled(spark) - before:
            time.sleep(0.1)
    assert not left and sum(r["n"] for r in out.collect()) == 499500
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


@pytest.mark.parametrize("name", ["first_hit_rank", "channel_stats", "pair_sampling"])
def test_lists_are_not_dealt_again_to_meet_the_truth(spark, name):
    dealt = exchanges(catalog.QUERIES[name](spark, SF))
    assert dealt and not [x for x in dealt if "cand_id" in x]


def test_fused_lists_marked_with_the_truth(spark):
    lists = spark.createDataFrame([("r", "x", "a", 1), ("r", "y", "a", 2), ("r", "x", "b", 2), ("r", "x", "b", 5), ("q", "y", "a", 1)], "ref_id string, channel string, cand_id string, rank int")
    truth = spark.createDataFrame([("r", "b"), ("r", "b"), ("r", "z"), ("s", "a")], "ref_id string, cand_id string")
    want = {tuple(r) for r in fusion.rrf(lists, 10).collect()}
    got = fusion.rrf(lists, 10, truth=truth)
    assert {(r["ref_id"], r["cand_id"], r["score"], r["rank"]) for r in got.collect()} == want
    assert [(r["ref_id"], r["cand_id"]) for r in got.where("hit = 1").collect()] == [("r", "b")]
    assert metrics.first_hit_rank(got, truth).collect() == metrics.first_hit_rank(fusion.rrf(lists, 10), truth).collect()


def test_hits_alone_meet_the_scripts(spark):
    plan = catalog.QUERIES["recall_by_script"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Filter[^\n]*hit#\d+ = 1", plan)


def test_lists_fused_in_turn_are_dealt_once(spark):
    assert len(exchanges(catalog.QUERIES["rrf_extra"](spark, SF))) == 1
    lists = linkage.stored_lists(spark, SF)
    plain = fusion.rrf_extra(fusion.rrf(lists.where("channel != 'char'"), 10), lists.where("channel = 'char'"), 60, 20)
    assert sorted(map(tuple, fusion.rrf_in_turn(lists, ["char"], 10, 60, 20).collect())) == sorted(map(tuple, plain.collect()))


def test_raw_and_calibrated_scores_meet_the_truth_once(spark, monkeypatch):
    asked, ece = [], metrics.ece
    monkeypatch.setattr(metrics, "ece", lambda *a, **b: asked.append(1) or ece(*a, **b))
    assert catalog.QUERIES["calibration_gain"](spark, SF).count() == 2 and len(asked) == 1
    rows = spark.createDataFrame([("a", 0.2, 0), ("a", 0.9, 1), ("b", 0.5, 1)], "option string, prob double, label int")
    assert {r["option"]: r["ece"] for r in ece(rows, by=["option"]).collect()} == {o: ece(rows.where(F.col("option") == o)).first()["ece"] for o in "ab"}


def test_isotonic_fit_sorts_distinct_scores_only(spark, monkeypatch):
    rows = spark.createDataFrame([(p / 10, int(p * n % 7 > 2)) for p in range(10) for n in range(1 + p % 4)], "prob double, label int")
    dense = models.IsotonicRegression(featuresCol="prob", labelCol="label").fit(rows)
    assert np.allclose(models.knots(models.fit_isotonic(rows)), models.knots(dense))
    seen, fit = [], models.fit_isotonic
    monkeypatch.setattr(models, "fit_isotonic", lambda df, **how: seen.append(df) or fit(df, **how))
    out = catalog.QUERIES["isotonic_fit"](spark, SF)
    assert seen[0].count() == seen[0].select("prob").distinct().count() == out.count()


def test_signals_of_pairs_in_one_pass(spark):
    lists = linkage.stored_lists(spark, SF)
    got = {(r["ref_id"], r["cand_id"]): (r["rrf_score"], r["channel_agreement"]) for r in fusion.signals(lists, 10, 3).collect()}
    found = fusion.rrf(lists, 10).join(fusion.agreement(lists, 3), ["ref_id", "cand_id"])
    assert got and got == {(r["ref_id"], r["cand_id"]): (r["score"], r["agreement"]) for r in found.collect()}
    assert len(exchanges(fusion.signals(lists, 10, 3))) == 1
