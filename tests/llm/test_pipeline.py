import __spark_entry__
import corpus_pipeline
import duckdb
import public_tokenizers as P
from pyspark.sql import functions as F

from kinweave.llm import bpe, decontaminate, langid, secrets
from tests.llm.test_simhash import expect

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what its predecessor kept, by plain code."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    model = langid.fit(docs)
    _, _, rejected = model.predict([r["text"] for r in rows.values()])
    rows = {i: r for (i, r), no in zip(rows.items(), rejected, strict=True) if not no}
    keep = {c for _, _, c in expect([(i, r["text"]) for i, r in rows.items()])}
    rows = {i: r for i, r in rows.items() if i in keep}
    index = decontaminate.build([(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    import numpy as np

    def clean(text):
        ids = np.array([index.vocabulary.get(w, 1) for w in decontaminate.words_of(text)], np.int32)
        joined = " ".join(decontaminate.words_of(text))
        far = (min(decontaminate.ends(x, joined, False)) > n for x, n in zip(index.phrases, index.char_edits, strict=True))
        return all(f and (decontaminate.nearest(p, ids)[0] if len(ids) else len(p)) > int(0.2 * len(p)) for f, (_, p) in zip(far, index.items, strict=True))

    rows = {i: r for i, r in rows.items() if clean(r["text"])}
    texts = {i: secrets.redact_text(r["text"]) for i, r in rows.items()}
    coder = bpe.Coder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    want = sorted((i, len(x) // 4) for i, x in zip(texts, coder.encode(list(texts.values())), strict=True))
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want
    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == columns, name
    assert 0 < len(want) < docs.count()


def test_odd_documents_pass_every_stage(spark, odd_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for empty in (False, True):
        stage = docs.limit(0) if empty else docs
        for _, f in corpus_pipeline.STAGES:
            stage = f(spark, stage, SF)
        assert (stage.count() == 0) == empty


OWN = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, rejected string, passages string, __kw_lang string, __KW_lang_ string, __kw_key string, fp string, h string, first string"


def test_own_columns_come_back_and_no_text_is_lost(spark):
    """Columns named like outputs and helpers, equal ids with different texts, repeated and blank rows, in any partitions."""
    import random

    r = random.Random(4)
    vocabulary = ["".join(r.choices("aeioulnrst", k=r.randint(3, 9))) for _ in range(4000)]
    text = lambda: " ".join(r.choices(vocabulary, k=80))
    a, b, c, d = (text() for _ in range(4))
    planted = [(1, a), (5, a), (5, b), (7, c), (7, d), (7, d), (None, a), (None, text()), (9, None), (10, "")]
    rows = planted + [(100 + i, text()) for i in range(60)]
    own = ["mine", "xx", "no", "none", "l", "L", "k", "f", "h", "1st"]
    rows = [(i, t, "en", "s", None if t is None else len(t), *own) for i, t in rows]
    results = []
    for seed in (1, 2):
        r.shuffle(rows)
        docs = spark.createDataFrame(rows, OWN).repartition(3 + seed)
        stage = docs
        for name, f in corpus_pipeline.STAGES[:-1]:
            stage = f(spark, stage, SF)
            assert stage.columns == docs.columns and stage.dtypes == docs.dtypes, name
            if name == "language_id":
                stage = docs  # what it rejects isn't this test's matter
        kept = stage.collect()
        assert all(tuple(x)[5:] == tuple(own) for x in kept)
        results.append(sorted(((x["doc_id"], x["text"]) for x in kept), key=str))
    assert results[0] == results[1]
    texts = [t for _, t in results[0]]
    assert {a, b, c, d} <= set(texts) and all(texts.count(t) == 1 for t in (a, b, c, d))
    assert (1, a) in results[0] and (5, b) in results[0] and len(texts) == 4 + 1 + 1 + 60


def test_repeated_rows_keep_the_same_one(spark):
    from kinweave.llm import simhash

    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", None), (2, "other words here now and then", "z")]
    seen = {str(sorted(map(str, simhash.keep_one(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string, fp string").repartition(k + 1)).collect()))) for k in range(3)}
    assert len(seen) == 1 and seen.pop().count("Row") == 2


def test_stages_are_removed_when_read(spark):
    import os

    from kinweave.llm.common import shared_folder

    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, SF).count() > 0
    (new,) = (x for x in set(os.listdir(folder)) - before if x.startswith("kinweave-pipeline"))
    assert os.listdir(f"{folder}/{new}") == [corpus_pipeline.STAGES[-1][0]]


def test_very_long_texts_pass_every_stage(spark):
    """Texts of several MB beside short ones: batches are bounded by bytes, and nothing is cut."""
    words = " ".join(f"w{i % 977}x{i % 31}" for i in range(400_000))
    rows = [(i, "die " + words if i % 2 else "the small text of few words", "en", "s", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(1)
    kept = corpus_pipeline.near_duplicates(spark, docs, SF)
    assert sorted(x["doc_id"] for x in kept.select("doc_id").collect()) == [0, 1]
    redacted = corpus_pipeline.secret_scan(spark, corpus_pipeline.benchmark_leaks(spark, kept, SF), SF)
    coded = {x["doc_id"]: x for x in corpus_pipeline.tokens(spark, redacted, SF).collect()}
    import hashlib

    assert coded[1]["decoded_sha256"] == hashlib.sha256(rows[1][1].encode()).hexdigest()


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert kept.count() > 0.99 * docs.count()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    assert docs.join(labels, "doc_id").join(kept.select("doc_id"), "doc_id", "left_anti").count() < 0.01 * labels.count()


def test_sql_of_queries(spark):
    from kinweave.llm import queries

    for name, sql in queries.ORACLE_SQL.items():
        con = duckdb.connect()
        for t in ("embeddings", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, SF)
        assert got.columns == names
        assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{k}" for k in range(1, 11)} and "pipeline" in names


def test_query_columns(spark):
    q = __spark_entry__.queries()
    assert [f.dataType.simpleString() for f in q["op4_license_scan"](spark, SF).schema] == ["bigint"] * 5 + ["string", "string", "double"]
    assert [f.dataType.simpleString() for f in q["op9_secrets"](spark, SF).schema] == ["bigint"] * 4 + ["string", "string"]
    assert dict(q["op7_language_id"](spark, SF).dtypes)["held_out"] == "boolean"
    assert q["op6_byte_bpe"](spark, SF).where(F.length("ids_sha256") != 64).count() == 0
