import json

import pytest

from kinweave.plans.linkage import link
from kinweave.operators.normalise import normalise
from kinweave.sources import records, sinks


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry"


def test_tsv_sources(spark, tmp_path):
    good = write(tmp_path / "a.tsv", HEAD, 'S1-1\tA "quoted" name\t\tUS', "S1-2\tNA\tnull\tIndia")
    rows = records.read_source(spark, good, 1).orderBy("entity_id").collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'A "quoted" name', "", "US"), ("S1-2", "NA", "null", "India")]
    with pytest.raises(records.InputError, match="prefix"):
        records.read_source(spark, good, 2)
    with pytest.raises(records.InputError, match="header"):
        records.read_source(spark, write(tmp_path / "b.tsv", "id\tname", "S1-1\tx"), 1)


def test_truth(spark, tmp_path):
    path = write(tmp_path / "gt.tsv", "source1_entity_id\tmatched_entity_ids", "S1-1\tS2-1, S3-2,,", "S1-2\t")
    own = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    refs, pairs = records.read_truth(spark, path, own)
    assert refs.count() == 2 and sorted(map(tuple, pairs.collect())) == [("S1-1", "S2-1"), ("S1-1", "S3-2")]
    refs, pairs = records.read_truth(spark, path, own, spark.createDataFrame([("S1-2",)], "ref_id string"))
    assert refs.count() == 1 and pairs.count() == 0
    with pytest.raises(records.InputError):
        records.read_truth(spark, path, own.where("entity_id = 'S1-1'"))


def test_candidate_lists(spark, tmp_path):
    for lines in (("S1-a\tS2-1,S3-2", "S1-b\t"), ("source1_entity_id\tcandidate_entity_ids", "S1-a\tS2-1,S3-2", "S1-b\t")):
        refs, pairs = records.read_candidates(spark, write(tmp_path / "c.tsv", *lines))
        assert sorted(r["ref_id"] for r in refs.collect()) == ["S1-a", "S1-b"] and sorted(map(tuple, pairs.collect())) == [("S1-a", 1, "S2-1"), ("S1-a", 2, "S3-2")]
    with pytest.raises(records.InputError):
        records.read_candidates(spark, write(tmp_path / "d.tsv", "S1-a\tS2-1"), strict=True)


def test_id_lists(spark, tmp_path):
    refs = spark.createDataFrame([("S1-a",), ("S1-b",)], "ref_id string")
    pairs = spark.createDataFrame([("S1-a", "S3-2", 1), ("S1-a", "S2-1", 2), ("S1-a", "S2-1", 2)], "ref_id string, cand_id string, rank int")
    sinks.write_id_lists(refs, pairs, str(tmp_path / "out"))
    lines = [x for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["source1_entity_id\tmatched_entity_ids", "S1-a\tS2-1,S3-2", "S1-b\t"]
    assert sinks.id_lists(refs, pairs.distinct(), "candidate_entity_ids", "rank").orderBy("source1_entity_id").first()[1] == "S3-2,S2-1"


def test_reports(tmp_path):
    path = str(tmp_path / "r.json")
    (tmp_path / "r.json").write_text(json.dumps({"recall": 0.5}))
    sinks.merge_report(path, "one", {"recall": 0.7})
    report = sinks.merge_report(path, "two", {"recall": 0.9})
    assert report["recall"] == 0.9 and set(report["runs"]) == {"earlier", "one", "two"} and json.load(open(path)) == report
    assert sinks.markdown([{"a": 1, "b": 0.5}, {"a": None, "b": "x|y"}]) == "| a | b |\n| --- | --- |\n| 1 | 0.5000 |\n|  | x\\|y |"


def test_bucket_scan(spark, tmp_path):
    rows = [("S1-1", "us"), ("S1-1", "us"), ("S1-2", "usa"), ("S1-3", "peru")]
    spark.createDataFrame(rows, "entity_id string, country_norm string").write.parquet(str(tmp_path / "t"))
    got = records.scan_bucket(spark, str(tmp_path / "t"), "us", ["entity_id"])
    assert sorted(r["entity_id"] for r in got.collect()) == ["S1-1", "S1-2"]
    assert "country_norm" in got._jdf.queryExecution().toString().split("PushedFilters")[1][:200]


def test_first_rows_ids_and_heads(spark, tmp_path):
    """Of a repeated id the first row of the first file stays, however the files are split."""
    rows = [(f"S1-{i}", "us", f"first{i}") for i in range(50)]
    spark.createDataFrame(rows, "entity_id string, country_norm string, name string").coalesce(1).write.parquet(str(tmp_path / "t/part=0"))
    spark.createDataFrame([(i, c, "later") for i, c, _ in rows[::2]] + [("S1-7", "us", "latest")], "entity_id string, country_norm string, name string").coalesce(1).write.parquet(str(tmp_path / "t/part=1"))
    got = {r["entity_id"]: r["name"] for r in records.scan_bucket(spark, str(tmp_path / "t"), "us", ["entity_id", "name"]).collect()}
    assert got == {i: n for i, _, n in rows}
    ids = spark.createDataFrame([("S1-3",), ("S1-11",), ("S1-2",), ("S9-1",)], "entity_id string")
    assert [r["entity_id"] for r in records.scan_bucket(spark, str(tmp_path / "t"), "us", ["entity_id"], ids, 2).collect()] == ["S1-11", "S1-2"]
    assert records.count_rows(spark, str(tmp_path / "t")) == 76


def test_tables_are_stored_once_for_each_state(spark, tmp_path):
    from kinweave.sources.folders import stored

    built = []
    source = str(tmp_path / "in")

    def build():
        built.append(1)
        return spark.read.parquet(source)

    spark.range(3).write.parquet(source)
    assert stored(spark, "x", [source], build).count() == 3 and stored(spark, "x", [source], build).count() == 3 and len(built) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert stored(spark, "x", [source], build).count() == 8 and len(built) == 2


def test_shared_folders_keep_their_scheme(spark):
    from kinweave.sources import folders

    assert folders.qualified(spark, "/tmp/kinweave-test") == "file:///tmp/kinweave-test"  # of the default file system
    assert folders.qualified(spark, "file:///tmp/kinweave-test/") == "file:///tmp/kinweave-test"


def test_a_folder_of_our_own_is_for_local_sessions_alone(monkeypatch, spark):
    from types import SimpleNamespace

    from kinweave.sources import folders

    monkeypatch.setattr(folders, "qualified", lambda _, folder: folder)
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a", getConf=lambda: {}))
    assert folders.shared_folder(session("local[2]")) == folders.shared_folder(session("local[2]")) != ""
    with pytest.raises(ValueError, match="checkpoint.dir"):
        folders.shared_folder(session("spark://host:7077"))


def test_link_end_to_end(spark):
    raw = []
    names = ["Acme", "Globex", "Initech", "Umbrella", "Stark", "Wayne", "Wonka", "Hooli", "Vandelay", "Cyberdyne"]
    for i, n in enumerate(names):
        where = f"{100 + i} {n.lower()}ville road austin tx {70000 + i}"
        raw += [(f"S1-{i}", f"{n} Industries Corp", where, "US"), (f"S2-{i}", f"{n.upper()} industries corporation", where, "usa"), (f"S3-{i}", f"Other {i} shop", f"{i} elm", "US")]
    recs = normalise(spark.createDataFrame(raw, "entity_id string, business_name string, business_address string, country string")).cache()
    from kinweave.config import Settings

    got = sorted((r["ref_id"], r["cand_id"]) for r in link(recs, s=Settings(word_max_df=0.5, char_max_df=0.5, word_min_df=1, char_min_df=1)).collect())
    assert got == sorted((f"S1-{i}", f"S2-{i}") for i in range(10))
