import gzip
import hashlib
import os

from kinweave.llm import warc
from kinweave.llm.common import new_folder


def expect(rows, least=1000):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, p in payloads:
        if i is not None:
            top[p] = max(i, top.get(p, i))
    out = []
    for i, p in payloads:
        again = len(p) >= least and p in top and i != top[p]
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top[p] if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


BIG, NEAR = "<p>ä</p>" * 300, "x" * 1000
ROWS = [(i, f"http://a/{i}", BIG if i % 3 == 0 else f"<b>{i}</b>") for i in range(60)] + [
    (None, None, None), (None, "http://a b/\n", BIG), (70, None, ""), (71, "u\r\nX: 1", "a\r\n\r\nb\x00"), (72, "é", NEAR), (73, "é", NEAR), (74, "v", "y" * 999), (75, "v", "y" * 999), (57, "http://a/57", BIG), (-5, "w", "<i/>"), (10**15, "far", "z" * 5000),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, digest string, shard int").repartition(3)


def test_round_trip(spark, monkeypatch):
    df = frame(spark, ROWS)
    assert got(warc.round_trip(df)) == expect(ROWS)
    monkeypatch.setattr(warc, "SHARD_BYTES", 3000)
    monkeypatch.setattr(warc, "MOST_BROADCAST", 0)
    assert got(warc.round_trip(df)) == expect(ROWS)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_payloads_and_urls_come_back(spark):
    back = {(r["page_id"], r["url"] and r["url"][:4]): r["payload"] for r in warc.round_trip(frame(spark, ROWS)).collect()}
    assert bytes(back[71, "u%0D"]) == b"a\r\n\r\nb\x00" and bytes(back[70, None]) == b""


def test_only_nulls_and_repeats(spark):
    rows = [(None, None, NEAR)] * 4 + [(5, "u", BIG)] * 3
    assert got(warc.round_trip(frame(spark, rows))) == expect(rows)


def test_files_are_deterministic_and_sorted(spark):
    names = []
    for n in (2, 5):
        folder = new_folder(spark, "test")
        manifest = warc.write(frame(spark, ROWS).repartition(n), folder)
        path = folder.removeprefix("file://")
        files = sorted(x for x in os.listdir(path) if x.endswith(".warc.gz"))
        assert not [x for x in os.listdir(path) if x.startswith("_temporary")]
        names.append([(x, hashlib.sha256(open(f"{path}/{x}", "rb").read()).hexdigest()) for x in files])
        assert {r["name"] for r in manifest.collect()} == set(files)
        ids = [int(x.split(b"X-Page-ID: ")[1].split(b"\r")[0] or -(10**9)) for f in files for x in gzip.open(f"{path}/{f}").read().split(b"WARC/1.1\r\n")[1:]]
        assert ids == sorted(ids)
    assert names[0] == names[1]


def test_uncommitted_files_are_not_read(spark):
    folder = new_folder(spark, "test")
    warc.write(frame(spark, ROWS), folder)
    with open(folder.removeprefix("file://") + "/_temporary-x-part-000000-00000.warc.gz", "wb") as f:
        f.write(b"lost attempt")
    assert got(warc.read(spark, folder)) == expect(ROWS)


def test_damage_is_found():
    import pytest

    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False)
    assert warc.parse(good)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse(good.replace(b"payload", b"payloaf"))


def test_ids_over_the_whole_range_and_heavy_cells(spark, monkeypatch):
    """Ids from the least to the largest long; a cell with most rows is cut into ranges, or by a hash where its ids are uneven."""
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(warc, "CELLS", 4)
    rows = [(-(2**63), "a", "first"), (2**63 - 1, "b", "last"), (0, "c", BIG)] + [(i, f"u{i}", f"{i} " * 200) for i in range(150)]
    assert got(warc.round_trip(frame(spark, rows))) == expect(rows)
    even = [(i, f"u{i}", f"{i:04d} " * 200) for i in range(400)]
    folder = new_folder(spark, "test")
    manifest = warc.write(frame(spark, even), folder)
    assert manifest.count() > 8
    path = folder.removeprefix("file://")
    ids = []
    for name in sorted(x for x in os.listdir(path) if x.startswith("part-")):
        with open(os.path.join(path, name), "rb") as f:
            ids.append([warc.parse(m)["page_id"] for m in warc.members(f.read())])
    assert [i for part in ids for i in part] == list(range(400))


def test_hadoop_names_of_one_store():
    import re

    assert re.sub(r"^s3[an]://", "s3://", "s3a://b/x") == "s3://b/x" and warc.store("file:///tmp/x")[1] == "/tmp/x"
