"""Collectors by source and their commands over stored answers."""

import hashlib
import html as markup
import json

from pyspark.sql import functions as F

from quillspark import cli
from quillspark.operators import store
from quillspark.sources import archive, collect, readers
from tests.test_sources import LEGACY, MODERN, NEW_NETWORK, OLD_GATED, OLD_NETWORK

HEAD = ["timestamp", "original", "mimetype", "statuscode", "digest", "length"]


def kept_page(folder, address, page):
    folder.mkdir(exist_ok=True)
    (folder / f"{hashlib.sha256(address.encode()).hexdigest()[:32]}.html").write_text(page, "utf-8")


def an_archive(tmp_path):
    """An index and its pages: two of the board in 2011, two of the network in 2014 of which one is gated, one in 2020."""
    rows = [
        ("20110105000000", "http://hh.ru/vacancy/1.do", LEGACY), ("20110106000000", "https://hh.ru/vacancy/2", MODERN), ("20110107000000", "https://hh.ru/vacancy/3", None),
        ("20140101000000", "https://www.linkedin.com/jobs2/view/11", OLD_NETWORK), ("20140102000000", "https://www.linkedin.com/jobs2/view/12", OLD_GATED),
        ("20200301000000", "https://www.linkedin.com/jobs/view/physicist-21", NEW_NETWORK),
    ]
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "1.json").write_text(json.dumps([HEAD, *[[t, a, "text/html", "200", "d", "1"] for t, a, _ in rows]]))
    for t, a, page in rows:
        if page:
            kept_page(tmp_path / "pages", f"http://web.archive.org/web/{t}id_/{a}", page)
    return str(tmp_path / "index"), str(tmp_path / "pages")


def test_archived_records(spark, tmp_path):
    index, pages = an_archive(tmp_path)
    captures = archive.index_responses(spark, index)
    found, rows = collect.archived(captures, "wayback-hhru", 2011, archive.stored(pages), tries=1)
    assert {r.original[-1]: r.error for r in found.collect()} == {"o": None, "2": None, "3": "missing"}
    got = {r.id: json.loads(r.data) for r in rows.collect()}
    assert got["2"]["name"] == "Data analyst" and got["2"]["salary"] == {"from": 80000, "to": 120000, "currency": "USD"} and [s["name"] for s in got["2"]["key_skills"]] == ["Python", "SQL"]
    assert got["1"]["published_at"] == "2011-01-12" and got["1"]["experience_years"] is None and got["1"]["_source"] == "wayback-hhru" and len(got) == 2
    _, rows = collect.archived(captures, "wayback-linkedin", 2014, archive.stored(pages), tries=1)
    (one,) = [json.loads(r.data) for r in rows.collect()]  # the gated page has no title
    assert one["id"] == "linkedin-11" and one["description"].startswith("[Industry: Pharma]") and one["salary"]["to"] == 120000 and one["published_at"] == "2014-05-06"
    _, rows = collect.archived(captures, "wayback-linkedin", 2020, archive.stored(pages), tries=1)
    assert [json.loads(r.data)["salary"]["from"] for r in rows.collect()] == [40000]
    _, rows = collect.archived(captures, "wayback-linkedin", 2018, archive.stored(pages), tries=1)
    assert rows.count() == 0


def test_bulk_and_channels(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "a.csv").write_text('Должность,Работодатель,Регион,Описание,url\nФизик,НИИ,Пермь,"Опыт работы 3 года, ""лазеры""",https://r.ru/1\nNaN,W,,d,\nХимик,nan,,,\n')
    got = {json.loads(r.data)["name"]: json.loads(r.data) for r in collect.bulk(spark, str(tmp_path / "csv"), "20240101000000").collect()}
    assert set(got) == {"Физик", "Химик"} and got["Физик"]["experience_years"] == 3.0 and got["Химик"]["employer"] == {"name": None}
    rows = [("lab", 7, "2023-02-01", "Вакансия: Физик\nКомпания: НИИ\nЗарплата: от 90 000 руб."), ("lab", 8, "2023", "")]
    (one,) = [json.loads(r.data) for r in collect.channel(spark.createDataFrame(rows, "channel string, id long, date string, text string"), "20240101000000").collect()]
    assert (one["id"], one["name"], one["employer"]["name"], one["salary"]["from"], one["year"]) == ("telegram-lab-7", "Физик", "НИИ", 90000, 2023)


def test_commands(spark, tmp_path, capsys):
    index, pages = an_archive(tmp_path)
    (tmp_path / "c.yaml").write_text(f"warehouse: {tmp_path}/w\n")
    call = lambda *a: cli.main(["--config", str(tmp_path / "c.yaml"), "--domain", "d", *map(str, a)])
    raw, runs = f"{tmp_path}/w/raw/domain=d", f"{tmp_path}/w/runs/domain=d"
    call("history", "--index", index, "--pages", pages, "--first", 2011, "--last", 2014)
    ids = {r.id for r in spark.read.parquet(raw).collect()}
    assert ids == {"1", "2", "linkedin-11"}
    call("archive", "wayback-hhru", index, pages, "--first", 2011, "--run", "again")
    assert "2 records fetched, 0 stored" in capsys.readouterr().out
    state = {r.run_id: (r.state, r.fetched, r.stored) for r in store.ledger_state(spark.read.parquet(runs), "run_id", "at").collect()}
    assert state["again"] == ("finished", 2, 0) and len(state) >= 4
    # a search, one of whose postings has no page of its own, and descriptions that come later
    host = "https://s.org"
    page = lambda data: f'<template id="X-InitialState">{markup.escape(json.dumps(data))}</template>'
    items = [{"vacancyId": 71, "name": "A"}, {"vacancyId": 72, "name": "B"}]
    kept_page(tmp_path / "pages", f"{host}/search/vacancy?text=lab&page=0", page({"vacancySearchResult": {"vacancies": items, "paging": {"next": {"disabled": True}}}}))
    kept_page(tmp_path / "pages", f"{host}/vacancy/71", page({"vacancyView": {"name": "A1", "description": "<p>d</p>", "keySkills": {"keySkill": ["x"]}}}))
    call("search", "lab", host, pages)
    assert "2 records fetched, 2 stored" in capsys.readouterr().out
    data = lambda: {r.id: json.loads(r.data) for r in spark.read.parquet(raw).where(F.col("id").startswith("7")).collect()}
    assert data()["72"]["description"] is None
    kept_page(tmp_path / "pages", f"{host}/vacancy/72", page({"vacancyView": {"name": "B", "description": "later", "keySkills": {"keySkill": ["y"]}}}))
    call("backfill", host, pages, "--dry-run")
    before = spark.read.parquet(raw).count()
    call("backfill", host, pages)
    assert "1 descriptions filled" in capsys.readouterr().out and spark.read.parquet(raw).count() == before
    assert data()["72"]["description"] == "later" and data()["72"]["key_skills"] == [{"name": "y"}] and data()["71"]["description"] == "d"


def test_frames_against_what_is_wanted(spark, tmp_path):
    df = spark.createDataFrame([("r1", "b", 2.0), ("r1", "a", 2.0), ("r1", "c", 5.0), ("r2", "z", 1.0)], "role string, skill string, tfidf_weight double")
    assert readers.schema_errors(df, {"role": "string", "n": "int", "tfidf_weight": "string"}) == ["missing column: n", "column tfidf_weight: double, not string"]
    assert readers.schema_errors(df, {"role": "str"}) == []
    assert readers.column_differences(df, ["role", "x"]) == (["x"], ["skill", "tfidf_weight"])
    assert {r.role: r.skills for r in readers.skill_lists(df).collect()} == {"r1": ["c", "a", "b"], "r2": ["z"]}
    readers.write_documents(df.groupBy("role").agg(F.collect_set("skill").alias("s")), str(tmp_path / "m"), "role")
    assert {r.role: set(r.s) for r in readers.documents(spark, str(tmp_path / "m")).collect()} == {"r1": {"a", "b", "c"}, "r2": {"z"}}
    (tmp_path / "r.json").write_text(json.dumps({"generated_at": "x", "results": [{"metric": "m", "value": 0.5}]}, indent=1))
    assert [tuple(r) for r in readers.metrics(spark, str(tmp_path / "r.json")).collect()] == [("m", 0.5)] and readers.metrics(spark, str(tmp_path / "no.json")).count() == 0
    lists = spark.createDataFrame([([5, 6],), ([],), (None,)], "x array<int>")
    assert [r[0] for r in lists.select(readers.first_value(F.col("x"))).collect()] == ["5", None, None]
    raw = spark.createDataFrame([(str(i), json.dumps({"description": "x" if i % 2 else None})) for i in range(6)], "id string, data string")
    assert {r.id for r in readers.missing_descriptions(raw).collect()} == {"0", "2", "4"} and [r.id for r in readers.missing_descriptions(raw, most=2).collect()] == ["0", "2"]
    patched = raw.limit(1).select(store.patched(F.col("data"), F.lit('{"a": [1]}'))).first()[0]
    assert json.loads(patched) == {"description": None, "a": [1]}
    assert cli.run_id("Data  Science Lab").startswith("data_science_lab-2")
