"""Sources, mappers, page parsers, scalar functions and streams on literal cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import html, text as tx
from quillspark.operators import axes, clusters, metrics, statistics, store
from quillspark.sources import mappers, readers
from quillspark.streaming import ingest

LEGACY = """<html><body><div class="vacancy-title">Инженер</div><span class="company-name">НИИ</span><span class="location">Москва</span>
<span class="salary">от 100 000 до 150 000 руб.</span><span class="vacancy-creation-date">12 января 2011</span><div class="vacancy-description">Опыт 1-3 года</div></body></html>"""
MODERN = """<html><body><h1 data-qa="vacancy-title">Data analyst</h1><a data-qa="vacancy-company-name">Lab</a><p data-qa="vacancy-view-location">Perm</p>
<span data-qa="vacancy-salary">$80,000 - $120,000</span><span data-qa="skills-element">Python</span><span data-qa="skills-element">SQL</span>
<script type="application/ld+json">{"description": "<p>Do <b>things</b></p>", "datePosted": "2020-02-03"}</script></body></html>"""
GATED = '<html><body><div class="login-form"><input></div></body></html>'
OLD_NETWORK = """<html><body><h1 class="title">Chemist</h1><a class="company-name-link">Lab Ltd</a><span class="job-location">Leeds</span>
<span class="posted-time">Posted on 2014-05-06 by staff</span><div class="description">We offer $80,000 - $120,000. Industry: Pharma, others</div>
<div class="job-criteria"><dl><dt>Seniority level:</dt><dd>Mid-Senior</dd><dt>Employment type</dt><dd>Full-time</dd></dl>
<ul><li><span class="criteria-label">Job function</span> <span class="criteria-value">Research</span></li><li>Other</li></ul></div>
<h3>Desired Skills</h3><ul><li>HPLC</li><li>NMR</li><li>HPLC</li></ul><span class="job-criteria__text">English</span></body></html>"""
NEW_NETWORK = """<html><body><h1 class="topcard__title">Physicist</h1><span class="topcard__flavor">Institute</span><span class="topcard__flavor--bullet">Kazan</span>
<time datetime="2021-03-04">2 weeks ago</time><div class="show-more-less-html__markup">Lasers. Experience level: Senior</div>
<li class="description__job-criteria-item">Employment: Contract</li><span class="description__job-criteria-text">Industry – Optics</span>
<div><h3>Skills wanted</h3><ul><li>Python</li></ul></div><div><ul><li>Optics</li></ul></div>
<script type="application/ld+json">[{"@type": "JobPosting", "title": "no", "datePosted": "2021-01-01", "baseSalary": {"currency": "EUR", "value": {"minValue": 40000.4, "maxValue": 50000}}}]</script></body></html>"""
LINKED_ONLY = """<html><body><p>x</p><script type="application/ld+json">{"@type": "JobPosting", "title": "Biologist", "description": "<p>Cells, $30/hr</p>", "datePosted": "2022-02-02",
"hiringOrganization": {"name": "Zoo"}, "baseSalary": {"currency": "USD", "value": {"maxValue": 9}}}</script></body></html>"""
OLD_GATED = "<html><body><h2>Sign in to go on</h2><div class='description'>secret</div></body></html>"


def test_page_layouts():
    old = html.parse_page(LEGACY, "board-legacy")
    assert (old["name"], old["employer"], old["area"], old["date_text"]) == ("Инженер", "НИИ", "Москва", "12 января 2011")
    new = html.parse_page(MODERN, "board-modern")
    assert new["skills"] == ["Python", "SQL"] and new["description"] == "Do things" and new["date_text"] == "2020-02-03"
    assert html.parse_page(GATED, "network-modern")["gated"] and html.parse_page(None, "board-modern")["name"] is None


def test_network_pages(spark):
    old = html.parse_page(OLD_NETWORK, "network-legacy")
    assert (old["name"], old["employer"], old["area"], old["date_text"]) == ("Chemist", "Lab Ltd", "Leeds", "2014-05-06")
    assert (old["experience"], old["schedule"], old["job_function"], old["industry"]) == ("Mid-Senior", "Full-time", "Research", "Pharma")
    assert old["skills"] == ["English", "HPLC", "NMR"] and old["salary_text"].startswith("We offer") and not old["gated"]
    new = html.parse_page(NEW_NETWORK, "network-modern")
    assert (new["name"], new["employer"], new["area"], new["date_text"]) == ("Physicist", "Institute", "Kazan", "2021-03-04")
    assert (new["experience"], new["schedule"], new["industry"], new["skills"]) == ("Senior", "Contract", "Optics", ["Python", "Optics"])
    assert (new["salary_from"], new["salary_to"], new["salary_currency"], new["salary_text"]) == (40000, 50000, "EUR", None)
    only = html.parse_page(LINKED_ONLY, "network-modern")
    assert (only["name"], only["employer"], only["description"], only["date_text"]) == ("Biologist", "Zoo", "Cells, $30/hr", "2022-02-02")
    assert only["salary_text"] == "Cells, $30/hr" and only["salary_to"] is None  # without a least salary the text counts
    for page, layout in ((GATED, "network-modern"), (GATED, "network-legacy"), (OLD_GATED, "network-legacy")):
        gated = html.parse_page(page, layout)
        assert gated["gated"] and gated["description"] is None and gated["skills"] == []
    assert not html.parse_page(OLD_GATED, "network-modern")["gated"]
    assert not html.parse_page(OLD_GATED.replace("<h2>", "<h1 class='title'>T</h1><h2>"), "network-legacy")["gated"]
    pages = spark.createDataFrame([(1, OLD_NETWORK, "network-legacy"), (2, NEW_NETWORK, "network-modern"), (3, LINKED_ONLY, "network-modern"), (4, None, "network-legacy")], "id int, html string, layout string")
    got = {}
    for layout in ("network-legacy", "network-modern"):
        own = html.parsed_pages(pages.where(F.col("layout") == layout), layout).select("id", html.posting_salary(F.col("parsed")).alias("s"))
        got |= {r.id: tuple(r.s) for r in own.collect()}
    assert got == {1: (80000, 120000, "USD"), 2: (40000, 50000, "EUR"), 3: (30, 30, "USD"), 4: (None, None, None)}


def test_parsed_column(spark):
    pages = spark.createDataFrame([(1, MODERN), (2, None), (3, "")], "id int, html string")
    got = {r.id: r.parsed for r in html.parsed_pages(pages, "board-modern").collect()}
    assert got[1].name == "Data analyst" and got[2].name is None and got[3].skills == []


def test_embedded_state(spark):
    page = '<template id="X-InitialState">{&quot;a&quot;: 1}</template>'
    df = spark.createDataFrame([(page,), ("none",)], "h string").select(html.embedded_state(F.col("h")).alias("s"))
    assert [r.s for r in df.collect()] == ['{"a": 1}', None]


@pytest.mark.parametrize(
    "given,want",
    [
        ("от 100 000 до 150 000 руб.", (100000, 150000, "RUR")),
        ("до 90 000 руб.", (None, 90000, "RUR")),
        ("от 50 000 руб.", (50000, None, "RUR")),
        ("$80,000 - $120,000", (80000, 120000, "USD")),
        ("$80,000", (80000, 80000, "USD")),
        ("80000", (None, None, None)),
        ("80K EUR", (None, None, "EUR")),
        ("EUR 80K", (80000, 80000, "EUR")),
        ("$40 - $60 per hour", (40, 60, "USD")),
        ("$50/hr", (50, 50, "USD")),
        ("50.5 per hour", (50 * 2080, 50 * 2080, None)),
        ("£90K to £100.5K", (90000, 100500, "GBP")),
        ("70\u00a0000 руб", (70000, None, "RUR")),
        ("", (None, None, None)),
        ("none", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_salary(spark, given, want):
    r = spark.createDataFrame([(given,)], "s string").select(tx.salary(F.col("s")).alias("x")).first().x
    assert (r["from"], r["to"], r["currency"]) == want


def test_dates_and_experience(spark):
    rows = [("12 января 2011", "2011-01-12"), ("03.02.2020", "2020-02-03"), ("2021-05-06", "2021-05-06"), ("soon ", "soon"), ("5.3.2020", "2020-03-05"), ("12.01.2011 10:30", "2011-01-12"), ("1 МАЯ 2019 года", "2019-05-01"), ("1 foo 2019", "1 foo 2019"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select("b", tx.iso_date(F.col("a")).alias("got"))
    assert all(r.got == r.b for r in df.collect())
    assert [r[0] for r in spark.createDataFrame([(0,), (2,), (10,), (-1,)], "n int").select(tx.bin_label(F.col("n"), [0, 1, 10])).collect()] == ["0–1", "1–10", "10+", None]
    rows = [("опыт работы от 3 лет", 3.0), ("1-3 года и опыт", 2.0), ("стаж работы 5-8 лет", 6.5), ("требуемый опыт 4 года", 4.0), ("5+ years", None), ("без опыта", None), (None, None)]
    df = spark.createDataFrame(rows, "a string, b double").select("b", tx.experience_years(F.col("a")).alias("got"))
    assert all(r.got == r.b for r in df.collect())
    words = spark.createDataFrame([(1, "год"), (2, "года"), (5, "лет"), (11, "лет"), (21, "год"), (112, "лет")], "n int, w string")
    assert words.where(tx.years_word(F.col("n")) != F.col("w")).isEmpty()


RECORDS = {
    "wayback-hhru": {"name": "A", "employer": {"name": "E"}, "key_skills": ["x", {"name": "y"}], "source_url": "https://hh.ru/vacancy/123?q=1"},
    "wayback-linkedin": {"name": "B", "employer": "E", "industry": "Labs", "description": "d", "source_url": "https://l.com/jobs/view/job-77"},
    "trudvsem": {"vacancy": {"id": "9", "job-name": "C", "requirements": "r", "duty": "t", "salary_min": 10, "skills": ["z"], "category": {"specialisation": "S"}, "vac_url": "https://t.ru/9"}},
    "rostud": {"Должность": "D", "Работодатель": "W", "Регион": "R", "Описание": "o"},
    "telegram": {"name": "F", "description": "f", "_source_url": "https://t.me/chan/5"},
}


def test_mappers_round_trip(spark):
    frames = []
    for source, record in RECORDS.items():
        rows = spark.createDataFrame([(json.dumps(record, ensure_ascii=False), "20200102030405")], "raw string, capture_ts string")
        frames.append(mappers.mapped(rows, source))
    table = mappers.enriched(mappers.unified(frames))
    good, bad = mappers.validated(table)
    assert good.count() == 5 and bad.count() == 0
    got = {r._source: r for r in good.collect()}
    assert got["wayback-hhru"].id == "123" and [s.name for s in got["wayback-hhru"].key_skills] == ["x", "y"]
    assert got["wayback-linkedin"].id == "linkedin-77" and got["wayback-linkedin"].description.startswith("[Industry: Labs]")
    assert got["trudvsem"].id == "trudvsem-9" and got["trudvsem"].salary["currency"] == "RUR" and got["trudvsem"].professional_roles[0].id == 0
    assert got["trudvsem"].description == "Требования: r\nОбязанности: t"
    assert got["telegram"].id == "telegram-chan-5" and got["rostud"].area.name == "R" and all(r.year == 2020 for r in got.values())
    broken = spark.createDataFrame([('{"name": ""}', "bad")], "raw string, capture_ts string")
    assert mappers.validated(mappers.mapped(broken, "telegram"))[1].first().errors == ["id", "name", "capture"]


def test_messages(spark):
    rows = [("#вакансия\nДолжность: Химик\nКомпания: НИИ\nГород: Томск\nЗП: от 70 000 руб.",), ("First line\nmore",), (None,)]
    got = mappers.messages(spark.createDataFrame(rows, "text string")).collect()
    assert (got[0].title, got[0].employer, got[0].area, got[0].salary["from"]) == ("Химик", "НИИ", "Томск", 70000)
    assert got[1].title == "First line" and got[1].employer is None and got[2].title == ""


def test_archive_rows(spark):
    rows = [(["timestamp", "original", "mimetype", "statuscode", "digest", "length"],), (["20110101000000", "http://a", "text/html", "", "d", "5"],)]
    got = mappers.archive_rows(spark.createDataFrame(rows, "fields array<string>")).collect()
    assert len(got) == 1 and got[0].statuscode is None and got[0].original == "http://a"


def test_store(spark):
    held = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (3, "z")], "id int, v string")
    once = store.insert_or_ignore(held, new, "id", [F.asc("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "b"), (3, "y")]
    assert sorted(map(tuple, store.insert_or_ignore(once, new, "id", [F.asc("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, v string")
    readers.write_parquet(df, str(tmp_path / "p"))
    assert readers.optional(spark, str(tmp_path / "p"), "id int, v string").count() == 1
    assert readers.optional(spark, str(tmp_path / "none"), "id int, v string").count() == 0
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert readers.json_lines(spark, str(tmp_path / "j.jsonl"), "a int").where("a is not null").count() == 2
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a.html").write_text(LEGACY)
    spark.dataSource.register(readers.SavedPages)
    assert spark.read.format("saved_pages").option("path", str(tmp_path / "pages")).load().first().html == LEGACY
    assert readers.weeks(spark, 2011).count() == 53
    assert readers.generated(spark, 50).exceptAll(readers.generated(spark, 50)).isEmpty()


def test_stream_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    for i in range(2):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"id": k, "v": i}) for k in range(3 + i)))
        ingest.store(ingest.records(spark, str(src), "id int, v int"), out, "id", "v", str(tmp_path / f"check{i}")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 1, 2, 3]


def test_thresholds_and_normalisation(spark):
    scores = spark.createDataFrame([("r1", "a", 1.0), ("r2", "a", 3.0), ("r1", "b", 2.0), ("r2", "b", 2.0)], "role string, axis string, x double")
    got = {(r.role, r.axis): r.score for r in axes.normalised(scores, "axis", "x").collect()}
    assert got == {("r1", "a"): 1.0, ("r2", "a"): 5.0, ("r1", "b"): 3.0, ("r2", "b"): 3.0}
    levels = axes.achieved(scores.withColumnRenamed("x", "proficiency")).where("role = 'r2'").collect()
    assert {round(r.threshold, 1) for r in levels} == {1.4, 2.0, 2.6, 3.4, 4.2, 4.8, 5.0}
    assert [r.achieved for r in sorted(levels, key=lambda r: r.level)] == [2, 2, 1, 0, 0, 0, 0]


def test_statistics_guards(spark):
    none = spark.createDataFrame([], "r string, c string, n long")
    assert statistics.chi_squared(none, "r", "c", "n").where("chi2 <> 0").isEmpty()
    two = spark.createDataFrame([("x", "p", 10), ("x", "q", 20), ("y", "p", 20), ("y", "q", 10)], "r string, c string, n long")
    r = statistics.chi_squared(two, "r", "c", "n").first()
    assert abs(r.chi2 - 5.4) < 1e-9 and r.dof == 1  # with Yates' correction
    assert abs(r.p - 0.020136751550346) < 1e-9
    series = spark.createDataFrame([("s", i, v) for i, v in enumerate([1, 2, 3, 5])] + [("t", 0, 1)], "k string, y int, v int")
    got = {r.k: (r.s, r.tau) for r in statistics.mann_kendall(series, ["k"], "y", "v").collect()}
    assert got == {"s": (6.0, 1.0), "t": (0.0, 0.0)}


def test_clusters():
    d = np.array([[0, 0.1, 0.9, 0.8], [0.1, 0, 0.85, 0.9], [0.9, 0.85, 0, 0.2], [0.8, 0.9, 0.2, 0]])
    labels = clusters.average_linkage(d, 2)
    assert labels[0] == labels[1] != labels[2] == labels[3]
    assert clusters.silhouette(d, labels) > 0.7 and clusters.silhouette(d, np.zeros(4)) == 0.0


def test_greedy_merges_at_the_threshold(spark):
    rows = [("b", 1, 5, [1.0, 0.0]), ("b", 2, 3, [0.85, float(np.sqrt(1 - 0.85**2))]), ("b", 3, 2, [0.0, 1.0])]
    got = clusters.greedy_leaders(spark.createDataFrame(rows, "k string, id int, n int, v array<double>"), "id", "n", "v", 0.85).collect()
    assert {r.id: r.leader for r in got} == {1: 1, 2: 1, 3: 3}


def test_rand_index_of_equal_labels(spark):
    rows = spark.createDataFrame([(i % 3, (i % 3) + 10) for i in range(30)], "a int, b int")
    assert metrics.adjusted_rand(rows, "a", "b").first().ari == 1.0
