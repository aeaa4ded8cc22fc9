"""Snapshots, logs and enumerated tables from files, and pair counts against all pairs."""

import hashlib
import json
import random

import pytest

from reviewlane.operators import census
from reviewlane.sources import snapshot

RECORD = "id long, v string"


@pytest.fixture
def pages(tmp_path):
    for name, records in {
        "b.json": [{"id": 1, "v": "b"}, {"id": 4, "v": "b1"}, {"id": 4, "v": "b2"}],
        "a.json": [{"id": 1, "v": "a"}, {"id": 2, "v": "a"}, {"v": "no id"}],
        "c.json": [],
        "notes.txt": "no page",
    }.items():
        (tmp_path / name).write_text(json.dumps(records))
    return str(tmp_path)


def test_pages_keep_the_last_record(spark, pages):
    found = snapshot.load_pages(spark, pages, RECORD, "id")
    assert {tuple(r) for r in found.collect()} == {(1, "b"), (2, "a"), (4, "b2")}


def test_a_broken_page_stops_the_query(spark, pages):
    from pathlib import Path

    Path(pages, "d.json").write_text('[{"id": 3')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        snapshot.load_pages(spark, pages, RECORD, "id").collect()


def test_manifest_and_gate(spark, pages, tmp_path):
    path = tmp_path / "manifest" / "m.json"
    path.parent.mkdir()
    assert snapshot.load_manifest(spark, str(path), "id long, sha string").count() == 0
    path.write_text(json.dumps({"end": "x", "observations": [{"id": 1, "sha": "s"}, {"id": 4, "sha": None}]}, indent=1))
    manifest = snapshot.load_manifest(spark, str(path), "id long, sha string")
    found = snapshot.load_pages(spark, pages, RECORD, "id")
    assert {tuple(r) for r in snapshot.load_snapshot(found, manifest, "id").collect()} == {(1, "b"), (4, "b2")}
    assert tuple(snapshot.orphans(found, manifest, "id").first()) == (3, 2, 1)
    path.write_text(json.dumps({"observations": [{"id": 1, "sha": "s"}, {"id": 9, "sha": "s"}]}))
    with pytest.raises(Exception, match="1 rows of the manifest have no record"):
        snapshot.load_snapshot(found, snapshot.load_manifest(spark, str(path), "id long, sha string"), "id").collect()


def test_lines_have_their_numbers(spark, tmp_path):
    lines = [json.dumps({"id": i, "v": "x" * (i % 50)}) for i in range(3000)]
    lines[1234], lines[7], lines[2000] = '{"id": 5', "", "[]"
    (tmp_path / "log.jsonl").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        read = snapshot.read_lines(spark, str(tmp_path), RECORD)
        assert read.rdd.getNumPartitions() > 1
        rows = read.collect()
        numbered = {r.number: r.value for r in snapshot.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert numbered == {i: line for i, line in enumerate(lines, 1)}
    assert {r.number: r.record and r.record.id for r in rows if r.number in (1235, 1, 3000)} == {1235: None, 1: 0, 3000: 2999}
    assert len(rows) == 2999
    with pytest.raises(Exception, match="line (1235|2001) of"):
        snapshot.accepted(read).collect()


def test_enumerated_answers(spark, tmp_path):
    def read(text):
        (tmp_path / "a.csv").write_text(text)
        return {tuple(r) for r in snapshot.read_enumerated(spark, str(tmp_path / "a.csv"), "item", {"label": ["yes", "no"]}).collect()}

    assert read("item,label,note\n1, yes ,x\n,,\n2,no,\n") == {("1", "yes"), ("2", "no")}
    with pytest.raises(Exception, match="label of 3 has no listed value"):
        read("item,label\n1,yes\n3,maybe\n")
    with pytest.raises(Exception, match="1 stands there more than once"):
        read("item,label\n1,yes\n1,no\n")


def test_hashes_of_files(spark, tmp_path):
    for name, content in (("a.png", b"a"), ("b.png", b"b"), ("d.png", b"d")):
        (tmp_path / name).write_bytes(content)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    manifest = spark.createDataFrame([("a.png", sha(b"a").upper()), ("b.png", sha(b"x")), ("c.png", sha(b"c"))], "name string, sha string")
    got = {tuple(r) for r in snapshot.hash_errors(spark, str(tmp_path), manifest, "name", "sha").collect()}
    assert got == {("b.png", "other content"), ("c.png", "missing"), ("d.png", "not in the manifest")}


def test_pairs_are_counted_like_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "a", "a", "b", "c"]), rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(120)]
    frame = spark.createDataFrame(rows, "id int, site string, station int, satellite string")
    same = lambda a, b: a is not None and a == b
    want = sum(a[0] != b[0] and same(a[1], b[1]) and not same(a[2], b[2]) and not same(a[3], b[3]) for a in rows for b in rows)
    assert census.pairs_only_excluded_by(frame, "site", ["station", "satellite"]).first().pairs == want
    stations = {s: {r[2] for r in rows if r[1] == s and r[2] is not None} for s in "abc"}
    got = census.shared_sites(frame, "site", "station").first()
    assert got.n_rows == sum(r[1] is not None for r in rows) and (got.n_sites, got.n_shared) == (3, sum(len(x) > 1 for x in stations.values()))
    assert census.pairs_only_excluded_by(frame.limit(0), "site", ["station"]).first().pairs == 0
