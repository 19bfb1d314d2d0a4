import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from knownat.operators.audit import cardinality_violations
from knownat.sources import archives, documents, tables


def test_one_archive_is_inflated_by_many_tasks(spark, tmp_path):
    path = tmp_path / "bulk.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as packed:
        for i in range(200):
            packed.writestr(f"CIK{i:010d}.json", f'{{"cik": {i}}}')
        packed.writestr("folder/", "")
        packed.writestr("notes.txt", "no\nfiler")
    found = documents.read_archive(spark, str(path), documents.FILER_MEMBER)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.payload for r in rows) == sorted(f'{{"cik": {i}}}' for i in range(200))
    assert len({r.task for r in rows}) > 1
    everything = archives.archive_members(spark, str(path)).collect()
    assert len(everything) == 201 and {r.bytes for r in everything if r.member == "notes.txt"} == {8}


def test_lines_are_streamed_in_batches(spark, tmp_path):
    draw = random.Random(1)
    lines = ["".join(draw.choices("ab é日", k=draw.randint(0, 60))) for _ in range(90_000)]
    path = tmp_path / "t.zip"
    with zipfile.ZipFile(path, "w") as packed:
        packed.writestr("sub.txt", "\r\n".join(lines) + "\n")
        packed.writestr("bad.txt", b"\xff\xfe\nplain")
        packed.writestr("empty.txt", b"")
    members = archives.archive_members(spark, str(path))
    got = archives.member_lines(members).collect()
    whole = {r.line: r.text for r in got if r.member == "sub.txt"}
    assert [whole[i] for i in range(len(lines))] == lines and len(whole) == len(lines)
    assert [r.text for r in got if r.member == "bad.txt"][1] == "plain"
    assert not [r for r in got if r.member == "empty.txt"]


def test_archives_and_files_written_in_order(spark, tmp_path, make):
    rows = [(f"a{i % 2}", f"m{i % 3}.txt", i, f"{i}\n") for i in range(40)] + [("a0", "m0.txt", 99, None)]
    made = make(rows, "archive string, member string, place long, text string").repartition(5)
    counts = archives.write_archives(made, str(tmp_path / "zips")).collect()
    assert sorted(map(tuple, counts)) == [("a0", 3), ("a1", 3)]
    with zipfile.ZipFile(tmp_path / "zips" / "a1.zip") as packed:
        assert packed.read("m1.txt").decode() == "".join(f"{i}\n" for i in range(40) if i % 6 == 1)
    files = archives.write_files(
        made.withColumnRenamed("member", "file"), str(tmp_path / "files")
    ).collect()
    body = "".join(f"{i}\n" for i in range(0, 40, 3)).encode()
    assert (tmp_path / "files" / "m0.txt").read_bytes() == body
    assert {r.file: r.bytes for r in files}["m0.txt"] == len(body)


def test_one_archive_or_file_is_written_by_many_tasks(spark, tmp_path, make, monkeypatch):
    monkeypatch.setattr(archives, "SEGMENT_BYTES", 2000)
    rows = [("a", f"m{i // 4:03d}.txt", i, f"line {i} " + "xyz" * (i % 30) + "\n") for i in range(400)]
    made = make(rows, "archive string, member string, place long, text string").repartition(5)
    segments = archives._in_ranges(made, ["archive", "place"], "text")
    sizes = [r["count"] for r in segments.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and len(sizes) > 5 and max(sizes) < 100
    assert archives.write_archives(made, str(tmp_path / "zips")).collect() == [("a", 100)]
    with zipfile.ZipFile(tmp_path / "zips" / "a.zip") as packed:
        assert packed.testzip() is None and len(packed.namelist()) == 100
        for k in range(100):
            body = "".join(r[3] for r in rows[4 * k : 4 * k + 4])
            assert packed.read(f"m{k:03d}.txt").decode() == body
    assert documents.read_archive(spark, str(tmp_path / "zips" / "a.zip")).count() == 100
    files = archives.write_files(
        made.drop("member").withColumnRenamed("archive", "file"), str(tmp_path / "files")
    ).collect()
    body = "".join(r[3] for r in rows).encode()
    assert (tmp_path / "files" / "a").read_bytes() == body and files == [("a", len(body))]
    assert [f.name for f in (tmp_path / "files").iterdir() if not f.name.startswith(".")] == ["a"]


def test_every_kind_of_artifact_gives_a_row(spark, tmp_path, make):
    for name in ("same", "other", "extra"):
        (tmp_path / name).write_bytes(name.encode() * 3_000_000)
    files = archives.list_files(spark, str(tmp_path))
    at = {r.path.rsplit("/", 1)[1]: r.path for r in files.collect()}
    digest = hashlib.sha256(b"same" * 3_000_000).hexdigest()
    manifest = make(
        [(at["same"], digest, 12_000_000), (at["other"], digest, 15_000_000), ("gone", digest, 1)],
        "path string, sha256 string, bytes long",
    )
    got = {r.path.rsplit("/", 1)[-1]: r.reason for r in tables.verify_files(files, manifest).collect()}
    assert got == {
        "same": None, "other": "checksum_or_size_mismatch", "gone": "artifact_missing",
        "extra": "artifact_unrecorded",
    }


def test_one_partition_is_replaced_and_reads_are_pruned(spark, tmp_path, make):
    rows = make([(i, f"f{i % 3}", i % 2) for i in range(60)], "n long, fold_id string, horizon int")
    path = str(tmp_path / "folds")
    tables.write_partitioned(rows, path)
    tables.write_partitioned(rows.where("fold_id = 'f1' AND horizon = 0 AND n < 20"), path, only=True)
    read = spark.read.parquet(path)
    assert {r.n for r in read.collect()} == {
        i for i in range(60) if not (i % 3 == 1 and i % 2 == 0) or i < 20
    }
    one = read.where("fold_id = 'f1'")
    assert "PartitionFilters: [isnotnull(fold_id" in one._jdf.queryExecution().toString()
    assert {r.f.split("fold_id=")[1][:2] for r in one.select(F.input_file_name().alias("f")).collect()} == {"f1"}


def test_a_published_table_may_be_built_from_itself(spark):
    tables.create_schemas(spark, ["swapped"])
    tables.publish(spark.range(10), "swapped.rows")
    tables.publish(spark.table("swapped.rows").where("id > 6"), "swapped.rows")
    assert sorted(r.id for r in spark.table("swapped.rows").collect()) == [7, 8, 9]
    assert [t.name for t in spark.catalog.listTables("swapped")] == ["rows"]


def test_metadata_rows_are_appended_or_refused(spark, make):
    tables.create_schemas(spark, ["kept"], metadata="kept")
    schema = ("run_id string, started_at_utc string, completed_at_utc string, status string, "
              "git_commit string, config_version string")

    def offer(*rows):
        made = make([(i, "2025-01-01 00:00:00", None, s, None, "1") for i, s in rows], schema)
        report = tables.append_new(made, "pipeline_runs", metadata="kept").collect()
        return sorted((r.run_id or "", r.outcome, r.detail) for r in report)

    assert offer(("a", "ok")) == [("a", "appended", "")]
    assert offer(("a", "ok"), ("b", "ok"), ("c", "ok"), ("c", "no"), ("d", None), (None, "ok")) == [
        ("", "required_column_empty", "run_id"), ("a", "key_present", ""), ("b", "appended", ""),
        ("c", "key_repeated", ""), ("c", "key_repeated", ""), ("d", "required_column_empty", "status"),
    ]
    assert sorted(r.run_id for r in spark.table("kept.pipeline_runs").collect()) == ["a", "b"]


@pytest.mark.parametrize("one_to_one", [False, True])
def test_cardinality_report_against_counting(make, one_to_one):
    draw = random.Random(3)
    left = [draw.randint(0, 20) for _ in range(30)]
    right = [draw.randint(5, 25) for _ in range(30)]
    got = cardinality_violations(
        make([(k,) for k in left], "k long"), make([(k,) for k in right], "k long"), ["k"],
        one_to_one=one_to_one,
    ).collect()
    wanted = set()
    for k in {*left, *right}:
        n, m = left.count(k), right.count(k)
        wanted |= {(k, side, n, m) for side, bad in (
            ("right", m > 1), ("unmatched", n > 0 == m), ("left", one_to_one and n > 1)) if bad}
    assert {tuple(r) for r in got} == wanted and len(got) == len(wanted)
