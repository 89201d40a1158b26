"""Strict readers, hashes in chunks, benchmark totals."""

import hashlib
import os
import resource

import pytest
from pyspark.sql import functions as F

from trackfold.operators import review
from trackfold.sources import hashes, lines

SCHEMA = "kind string, t_ms long"
GOOD = b'{"kind": "ball", "t_ms": 1}\n{"kind": "pl\xc3\xa4yer", "t_ms": 2}\r\n'


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, data in files.items():
        (folder / f"{name}.jsonl").write_bytes(data)
    return str(folder)


def test_places_of_lines(spark, tmp_path):
    data = b"".join(b"%d%s\n" % (i, b"x" * (i % 50)) for i in range(3000)) + b"\n\nlast"
    path = put(tmp_path / "in", a=data, b=b"", c=GOOD)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")  # splits within lines
    try:
        got = {(os.path.basename(r.file), r.offset): r.value for r in lines.lines(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = {}
    for name, text in (("a", data), ("c", GOOD)):
        at = 0
        for line in text.split(b"\n")[: None if not text.endswith(b"\n") else -1]:
            want[f"{name}.jsonl", at] = line.decode()
            at += len(line) + 1
    assert got == want


def test_valid_bad_blank_and_absent_input(spark, tmp_path):
    good = put(tmp_path / "good", a=GOOD, b=GOOD)
    assert lines.strict_rows(spark, good, SCHEMA, blanks=True).count() == 4
    bad = put(tmp_path / "bad", a=GOOD, b=GOOD + b'{"kind": \n' + GOOD)
    with pytest.raises(Exception, match=rf"no JSON object at \S*b\.jsonl, byte {len(GOOD)}"):
        lines.strict_rows(spark, bad, SCHEMA).count()
    for odd in (b"[]\n", b"null\n", b"3\n", b'"x"\n', b'{"kind": "a", "t_ms": "late"}\n'):
        with pytest.raises(Exception, match="no JSON object"):
            lines.strict_rows(spark, put(tmp_path / "odd", a=odd), SCHEMA).count()
    blank = put(tmp_path / "blank", a=GOOD + b" \t\r\n" + GOOD)
    assert lines.strict_rows(spark, blank, SCHEMA).select("t_ms").count() == 4
    with pytest.raises(Exception, match=rf"blank line at \S*a\.jsonl, byte {len(GOOD)}"):
        lines.strict_rows(spark, blank, SCHEMA, blanks=True).count()
    assert lines.strict_rows(spark, str(tmp_path / "none"), SCHEMA).count() == 0
    with pytest.raises(FileNotFoundError):
        lines.strict_rows(spark, str(tmp_path / "none"), SCHEMA, must_exist=True)


def test_streams_stop_at_bad_lines_and_end_without_input(spark, tmp_path):
    def drained(name, folder, **more):
        out = str(tmp_path / f"out-{name}")
        return lines.drained(lines.strict_stream(spark, folder, SCHEMA, **more), out, str(tmp_path / f"mark-{name}")), out

    assert drained("none", str(tmp_path / "none"))[0] == 0
    batches, out = drained("good", put(tmp_path / "good", a=GOOD, b=GOOD), maxFilesPerTrigger=1)
    assert batches == 2 and spark.read.parquet(out).count() == 4
    with pytest.raises(Exception, match=rf"no JSON object at \S*a\.jsonl, split 0, byte {len(GOOD)}"):
        drained("bad", put(tmp_path / "bad", a=GOOD + b"oops\n"))
    with pytest.raises(Exception, match="blank line"):
        drained("blank", put(tmp_path / "blank", a=GOOD + b"\n"), blanks=True)
    assert drained("left", put(tmp_path / "blank", a=GOOD + b"\n"))[0] == 1


def test_hashes_of_chunks(spark, tmp_path):
    files = {"a": b"", "b": b"x", "c": os.urandom(8192), "d d%20": os.urandom(100_000)}
    (tmp_path / "deep").mkdir()
    for i, (name, data) in enumerate(files.items()):
        (tmp_path / ("deep" if i % 2 else ".") / name).write_bytes(data)
    got = {hashlib.sha256(files[n]).hexdigest(): r.length for r in hashes.file_hashes(spark, str(tmp_path), chunk=1000).collect() for n in files if r.sha256 == hashlib.sha256(files[n]).hexdigest()}
    assert got == {hashlib.sha256(d).hexdigest(): len(d) for d in files.values() if d}  # Spark scans no empty files
    assert hashes.sha256_of(str(tmp_path / "a")) == hashlib.sha256(b"").hexdigest()


def test_files_are_dealt_by_size(spark):
    sizes = [(f"big{i}", 1000 + i) for i in range(6)] + [(f"s{i}", 1) for i in range(500)]
    out = hashes.dealt(spark.createDataFrame(sizes, "path string, length long"), task_bytes=1100)
    loads = {r.p: r.n for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("length").alias("n")).collect()}
    assert out.count() == 506 and len(loads) == 6 and max(loads.values()) < 1250
    assert hashes.dealt(spark.createDataFrame([], "path string, length long")).count() == 0


def test_a_file_of_three_gigabytes(tmp_path):
    path = tmp_path / "large"
    with open(path, "wb") as f:
        f.truncate(3 << 30)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    digest = hashes.sha256_of(f"file://{path}")
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kilobytes
    want, block = hashlib.sha256(), bytes(1 << 24)
    for _ in range(192):
        want.update(block)
    assert digest == want.hexdigest()


def test_benchmark_totals(spark):
    pose = [[0.0, 0.0], [1.0, 1.0]]
    far = [[0.0, 0.2], [1.0, 1.0]]
    truth = [("g", 1, 100, "id_verification", "correct", pose), ("g", 1, 100, "id_verification", "correct", pose), ("g", 2, 100, "id_verification", "wrong", pose), ("g", 3, 100, "pose", "correct", pose), ("g", 4, 500, "pose", None, None), ("h", 9, 0, None, None, None)]
    found = [(1, 120, 5, far), (1, 90, 7, pose), (2, 133, 1, pose), (3, 67, 1, pose), (3, 68, 2, None), (4, 500, 1, pose)]
    t = spark.createDataFrame(truth, "clip string, track_id long, t_ms long, type string, label string, pose array<array<double>>")
    f = spark.createDataFrame(found, "track_id long, t_ms long, ord long, pose array<array<double>>")
    got = {r.clip: tuple(r)[1:] for r in review.benchmark_totals(t, f, ["clip"]).collect()}
    # track 1 twice (its first row in order is the far one), 3 by its second row (no pose), 4; 2 is 33 ms away
    assert got == {"g": (5, 4, 0.5, 0.5), "h": (1, 0, 0.0, 0.0)}


def test_benchmark_carries_no_pose_through_the_match(spark):
    """Poses are neither grouped by nor compared by times; each goes flat to the row that it is matched with."""
    t = spark.createDataFrame([], "clip string, track_id long, t_ms long, type string, label string, pose array<array<double>>")
    f = spark.createDataFrame([], "track_id long, t_ms long, ord long, pose array<array<double>>")
    plan = review.benchmark_totals(t, f, ["clip"])._jdf.queryExecution().optimizedPlan()
    assert not any("pose" in line.split("], [")[0] for line in plan.toString().splitlines() if "Aggregate [" in line)
    assert not any("pose" in c for line in plan.toString().splitlines() if "Generate explode" in line for c in line.split("[")[1:])


def test_benchmark_ties_groups_and_odd_poses(spark):
    pose, far = [[0.0, 0.0], [1.0, 1.0]], [[0.0, 0.2], [1.0, 1.0]]
    truth = [("g", 1, 100, "id_verification", "correct", pose), ("h", 1, 100, "id_verification", "correct", pose), (None, 1, 100, "pose", None, pose), ("g", None, 100, "pose", None, pose), ("g", 2, 0, "pose", None, []), ("g", 3, 0, "pose", None, [[0.0, 0.0], None, [2.0, 2.0]])]
    # equal ord: the earlier one; exact copies count once; a shorter pose lacks joints
    found = [("g", 1, 110, 5, pose), ("g", 1, 90, 5, far), ("g", 1, 90, 5, far), ("g", 2, 0, 1, pose), ("g", 3, 0, 1, [[0.0, 0.0]])]
    t = spark.createDataFrame(truth, "clip string, track_id long, t_ms long, type string, label string, pose array<array<double>>")
    f = spark.createDataFrame(found, "clip string, track_id long, t_ms long, ord long, pose array<array<double>>")
    got = {r.clip: tuple(r)[1:] for r in review.benchmark_totals(t, f, ["clip"]).collect()}
    assert got == {"g": (4, 3, 1 / 3, (1 / 2 + 1 / 3) / 2), "h": (1, 0, 0.0, 0.0), None: (1, 0, 0.0, 0.0)}
