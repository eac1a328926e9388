"""The archive and open data, against stored answers."""

import json

import pytest
from pyspark.sql import functions as F

from quillspark.sources import archive, open_data


def test_index_responses_and_queries(spark, tmp_path):
    head = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]
    rows = [["20200101000000", "http://www.a.org/v/1?x", "text/html", "200", "d", "1"], ["20200103000000", "https://a.org/v/1/", "text/html", "200", "d", "1"],
            ["20200109000000", "https://a.org/v/1/", "text/html", "200", "d", "1"], ["20200104000000", "https://a.org/w/2", "text/html", "404", "d", "1"]]
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "1.json").write_text(json.dumps([head, *rows[:2], ["resume"]]))
    (tmp_path / "i" / "2.json").write_text(json.dumps([head, *rows[2:], []]))
    (tmp_path / "i" / "3.json").write_text("[]")
    captures = archive.index_responses(spark, str(tmp_path / "i"))
    assert captures.count() == 4
    assert archive.index_query(captures, "a.org/v/*").count() == 3 and archive.index_query(captures, "a.org/v/1", collapse=True).first().timestamp == "20200101000000"
    assert archive.index_query(captures, "a.org/v/*", "20200102", "20200103").count() == 1 and archive.index_query(captures, "a.org/*", status=None).count() == 4
    year = {r.original: (str(r.window), r.timestamp) for r in archive.yearly(captures, "a.org/v/*", 2020).collect()}
    assert year == {"http://www.a.org/v/1?x": ("2020-01-01", "20200101000000"), "https://a.org/v/1/": ("2020-01-08", "20200109000000")}


def test_eras(spark):
    assert archive.era_pattern(2014).startswith("linkedin.com/jobs2") and archive.era_pattern(2017) is None
    with pytest.raises(ValueError):
        archive.era_pattern(2012)
    rows = [("20200105000000", "https://www.linkedin.com/jobs/view/7", "text/html", "200"), ("20140105000000", "https://linkedin.com/jobs/view/7", "text/html", "200")]
    captures = spark.createDataFrame(rows, "timestamp string, original string, mimetype string, statuscode string")
    assert archive.by_era(captures, 2020).count() == 1 and archive.by_era(captures, 2014).count() == 0 and archive.by_era(captures, 2018).count() == 0


def test_retries():
    answers, waits = iter([(503, "", ""), (429, "", ""), (200, "text/html", "x")]), []
    assert archive.retried(lambda _: next(answers), "u", sleep=waits.append) == (200, "text/html", "x") and waits == [1.0, 2.0]
    waits.clear()
    assert archive.retried(lambda _: (500, "", ""), "u", tries=9, first=16.0, sleep=waits.append)[0] == 500 and waits == [16.0, 32.0, *[60.0] * 6]
    assert archive.retried(lambda _: (404, "", ""), "u", sleep=waits.append)[0] == 404 and len(waits) == 8


def test_fetching(spark):
    def fetch(address):
        name = address.rsplit("/", 1)[1]
        return {"ok": (200, "text/html; charset=utf-8", "<p>x</p>"), "png": (200, "image/png", ""), "gone": (404, "", "")}.get(name, (500, "", ""))

    captures = spark.createDataFrame([("20200101", f"http://a/{x}") for x in ("ok", "png", "gone", "bad")], "timestamp string, original string")
    got = {r.original[-3:]: (r.html, r.error) for r in archive.recovered(captures, fetch, tries=1).collect()}
    assert got == {"/ok": ("<p>x</p>", None), "png": (None, "type"), "one": (None, "missing"), "bad": (None, "failed")}
    assert {r.error: r.n for r in archive.error_counts(archive.fetched(captures, fetch, tries=1)).collect()} == {"none": 1, "type": 1, "missing": 1, "failed": 1}


def stored(folder, text, region, ids, total=None, size=100):
    at = folder / (text or "_") / (region or "_")
    at.mkdir(parents=True)
    later = open_data.NEXT if text else open_data.FIRST
    cuts = [0, *range(size, max(len(ids), size), later)]
    for lo, hi in zip(cuts, [*cuts[1:], len(ids)]):
        found = [{"vacancy": {"id": str(i)}} for i in ids[lo:hi]]
        (at / f"{lo}.json").write_text(json.dumps({"status": "200", "meta": {"total": total or len(ids)}, "results": {"vacancies": found}}))


def test_open_data(spark, tmp_path):
    stored(tmp_path, None, None, range(250))
    stored(tmp_path, "few", None, range(1000, 1040))
    stored(tmp_path, "many", None, range(2000, 2130), total=500)
    stored(tmp_path, "many", "r1", range(2000, 2090))
    stored(tmp_path, "many", "r2", range(2080, 2100))
    answer, given = open_data.stored(str(tmp_path)), {}
    assert len(list(open_data.scan(answer))) == 250 and open_data.count(answer, text="many") == 500
    assert len(list(open_data.scan(answer, text="many"))) == open_data.MOST_WITH_TEXT
    assert open_data.queries(answer, ["few", "many", "few"], ["r1", "r2"]) == [("few", None), ("many", "r1"), ("many", "r2")]
    rows = open_data.collected(spark, str(tmp_path), ["few", "many"], ["r1", "r2"])
    assert {int(r.id) for r in rows.collect()} == {*range(1000, 1040), *range(2000, 2100)} and rows.count() == 140
    assert open_data.collected(spark, str(tmp_path)).count() == 250
    assert open_data.collected(spark, str(tmp_path), ["many"], ["r2"], split="always").count() == 20
    assert open_data.parameters(5, 10, text="x", start="2020") == {"offset": 5, "limit": 10, "text": "x", "modifiedFrom": "2020"}
    waits, tries = [], iter([{"status": "500"}, {"status": "200", "meta": {"total": 3}}])
    assert open_data.retried(lambda page: next(tries), given, sleep=waits.append)["meta"]["total"] == 3 and waits == [2.0]
    with pytest.raises(RuntimeError):
        open_data.retried(lambda page: {"status": "500"}, given, sleep=waits.append)


def test_channel_messages(spark, tmp_path):
    rows = [{"channel": "c", "id": i, "date": "d", "text": t} for i, t in enumerate(["Химик", "x", "", "ХИМИЯ", "физик"])] + [{"channel": "e", "id": 9, "date": "d", "text": "хим"}]
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    got = lambda **k: sorted(r.id for r in open_data.channel_messages(spark, str(tmp_path / "m.jsonl"), **k).collect())
    assert got(keywords=["хим"]) == [0, 3, 9] and got(keywords=["хим"], last=2) == [3, 9] and got() == [0, 1, 3, 4, 9]
    assert open_data.channel_messages(spark, str(tmp_path / "m.jsonl")).where(F.col("text") == "").count() == 0


def test_commands(spark, tmp_path, capsys):
    from quillspark import cli
    from quillspark.operators import store

    (tmp_path / "c.yaml").write_text(f"warehouse: {tmp_path}/w\n")
    call = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), "--domain", "d", *map(str, a)])
    stored(tmp_path / "s", None, None, range(120))
    call("collect", tmp_path / "s", "--dry-run")
    assert "120 records" in capsys.readouterr().out
    call("collect", tmp_path / "s", "--run", "r1")
    call("collect", tmp_path / "s", "--run", "r2")
    assert spark.read.parquet(f"{tmp_path}/w/raw").count() == 120
    assert "120 records fetched, 0 stored" in capsys.readouterr().out
    runs = store.ledger_state(spark.read.parquet(f"{tmp_path}/w/runs"), "run_id", "at").collect()
    assert sorted((r.run_id, r.state, r.fetched, r.stored) for r in runs) == [("r1", "finished", 120, 120), ("r2", "finished", 120, 0)]
    call("verify")
    call("merge", f"{tmp_path}/w/raw/domain=d", f"{tmp_path}/w/raw/domain=d", tmp_path / "m")
    assert "0 records merged" in capsys.readouterr().out
    (tmp_path / "i").mkdir()
    rows = [["timestamp", "original", "mimetype", "statuscode", "digest", "length"], *([f"2020010{i}000000", f"https://a.org/v/{i % 2}", "text/html", "200", "d", "1"] for i in range(1, 6))]
    (tmp_path / "i" / "1.json").write_text(json.dumps(rows))
    call("census", tmp_path / "i", "site", "a.org/*", "--out", tmp_path / "r" / "c.json")
    out = capsys.readouterr().out
    assert "Total estimated records: 5" in out and f"{'site':<24} {'a.org/*':<36} {2020:>6}  {5:>10,} {2:>8,}" in out
    assert json.loads((tmp_path / "r" / "c.json").read_text())["results"][0]["urls"] == 2
    call("generate", tmp_path / "g", "--rows", 30)
    assert spark.read.parquet(str(tmp_path / "g")).count() == 30
