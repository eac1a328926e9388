"""The bucketed store and the passes of recovery."""

import hashlib
import json
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.sources import archive, keyed
from quillspark.streaming import ingest

SCHEMA = "id string, at string, data string"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def test_first_version_wins(spark, tmp_path):
    path = str(tmp_path / "s")
    assert keyed.insert(rows(spark, ("a", "2", "late"), ("a", "1", "early"), ("a", None, "none"), ("b", None, "y"), ("b", None, "x"), (None, "1", "z")), path, "id", "at", 8) == 2
    assert keyed.insert(rows(spark, ("a", "0", "stored wins"), ("c", "1", "c")), path, "id", "at", 8) == 1
    assert keyed.insert(rows(spark, ("a", "0", "stored wins"), ("c", "1", "c")), path, "id", "at", 8) == 0
    assert {tuple(r) for r in keyed.read(spark, path, SCHEMA).drop("bucket").collect()} == {("a", "1", "early"), ("b", None, "x"), ("c", "1", "c")}
    assert keyed.read(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_a_batch_reads_its_buckets_alone(spark, tmp_path):
    path, own = str(tmp_path / "s"), [str(i) for i in range(400)]
    assert keyed.insert(rows(spark, *[(i, "1", "x") for i in own]), path, "id", "at", 16) == 400
    batch = rows(spark, ("7", "1", "again"), ("new", "1", "y"))
    wanted = {r[0] for r in batch.select(keyed.bucket_of("id", 16)).collect()}
    fresh = keyed.missing(batch, path, "id", "at", 16)
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    held = keyed.read(spark, path, SCHEMA, sorted(wanted))
    folders = {Path(f).parent.name for f in [r[0] for r in held.select(F.input_file_name()).distinct().collect()]}
    assert folders == {f"bucket={b}" for b in wanted} and len(wanted) < 16
    before = {f: f.stat().st_mtime_ns for f in Path(path).glob("bucket=*/*.parquet")}
    assert keyed.insert(batch, path, "id", "at", 16) == 1
    after = {f: f.stat().st_mtime_ns for f in Path(path).glob("bucket=*/*.parquet")}
    assert {f.parent.name for f in after.keys() - before.keys()} <= {f"bucket={b}" for b in wanted}
    assert all(after[f] == t for f, t in before.items())


def test_streamed_batches_and_replays(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"id": str(i), "at": f"{9 - n}", "data": f"f{n}"}) for i in range(n * 5, n * 5 + 10)))
    for checkpoint in ("c1", "c2"):  # the second time every file is read again
        stream = ingest.records(spark, str(tmp_path / "in"), SCHEMA, 1)
        ingest.store(stream, str(tmp_path / "s"), "id", "at", str(tmp_path / checkpoint), 8).awaitTermination()
        got = keyed.read(spark, str(tmp_path / "s"), SCHEMA)
        assert Counter(r.id for r in got.collect()) == Counter(str(i) for i in range(20))


def chance(folder: str, most: int):
    """A transport that fails by hash of address and call, for at most `most` calls, and writes a file a call."""

    def fetch(address: str):
        own = Path(folder) / hashlib.md5(address.encode()).hexdigest()
        own.mkdir(exist_ok=True)
        nth = len(list(own.iterdir()))
        (own / str(nth)).touch()
        if address.endswith("/gone"):
            return 404, "text/html", ""
        fails = nth < most and hashlib.md5(f"{address}{nth}".encode()).digest()[0] % 2
        return (503, "text/html", "") if fails else (200, "text/html; charset=utf-8", f"<p>{address}")

    return fetch


def test_recovery_asks_once_a_pass_and_keeps_all(spark, tmp_path):
    addresses = [f"a.org/{i}" for i in range(200)] + ["a.org/gone"]
    captures = spark.createDataFrame([("20200101000000", a) for a in addresses] + [("20200101000000", addresses[0])], "timestamp string, original string").repartition(4)
    found = archive.recovered(captures, chance(str(tmp_path), 3), passes=4, tries=1, first=0.0)
    pages = found.collect()
    assert found.count() == 201 and found.where("error is null").count() == 200  # reading it again fetches nothing
    assert Counter(r.original for r in pages) == Counter(addresses)
    calls = {}
    for a in addresses:
        own = tmp_path / hashlib.md5(f"http://web.archive.org/web/20200101000000id_/{a}".encode()).hexdigest()
        calls[a] = len(list(own.iterdir()))
    want = {}
    for a in addresses:
        full, n = f"http://web.archive.org/web/20200101000000id_/{a}", 1
        while not a.endswith("gone") and n < 4 and hashlib.md5(f"{full}{n - 1}".encode()).digest()[0] % 2:
            n += 1
        want[a] = n
    assert calls == want
    assert {r.original: r.error for r in pages}["a.org/gone"] == "missing"


def test_recovery_pauses_and_ends(spark, tmp_path):
    captures = spark.createDataFrame([("20200101000000", "a.org/gone"), ("20200101000000", "a.org/x")], "timestamp string, original string")
    waits = []
    found = archive.recovered(captures, chance(str(tmp_path), 0), passes=3, again=("failed", "missing"), pause=15.0, sleep=waits.append, tries=1)
    assert waits == [15.0, 30.0] and {r.original: r.error for r in found.collect()} == {"a.org/gone": "missing", "a.org/x": None}
    assert archive.recovered(captures.limit(0), chance(str(tmp_path), 0)).count() == 0
