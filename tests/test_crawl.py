"""Throttled clients, the index as a stream that goes on where it stopped, and crawls."""

import html
import json
import time
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.sources import capture_index, crawl
from quillspark.sources.clients import Client


def test_client():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(round(s, 6))
        now[0] += s

    closed = []
    with Client(lambda x: x + 1, 4.0, lambda: now[0], sleep, lambda: closed.append(1)) as client:
        assert [client(1), client(2)] == [2, 3] and waits == [0.25]
        now[0] += 0.1
        client(3)
        now[0] += 9
        client(4)
    assert waits == [0.25, 0.15] and client.calls == 4 and closed == [1]
    client.close()
    assert closed == [1]
    with pytest.raises(RuntimeError):
        client(5)
    with pytest.raises(ValueError):
        Client(lambda: None, 0)


def capture(pattern, page, i):
    return [f"2020010{i}000000", f"https://{pattern}/{page}/{i}", "text/html", "200", "d", "1"]


class Logged(capture_index.CaptureIndex):
    """Pages by rule, each call noted in a file."""

    @classmethod
    def name(cls):
        return "logged_index"

    def page(self):
        folder, sizes = Path(self.options["path"]), {"a.org/*": 6, "b.org/*": 2}

        def page(pattern, key):
            number = int(key[1:]) if key else 0
            (folder / f"{pattern[0]}-{number}-{time.monotonic_ns()}").touch()
            rows = [list(capture_index.FIELDS)] * (number == 0) + [capture(pattern[:5], number, i) for i in range(1, 4)]
            return [*rows, [f"k{number + 1}"] if number + 1 < sizes[pattern] else []]

        return page


def drained(stream, out, check, stop_after=None):
    """Runs the stream until it is done, or until so many batches have come."""
    done = []

    def keep(batch, nth):
        batch.write.mode("overwrite").parquet(f"{out}/{nth}")
        done.append(nth)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", check).trigger(processingTime="100 milliseconds").start()
    until = time.time() + 120
    while query.isActive and time.time() < until and len(done) < (stop_after or 10**9):
        if stop_after is None and query.lastProgress and '"page"' not in str(done) and query.status["message"].startswith("Waiting") and len(done):
            last = query.recentProgress[-1]
            if last["numInputRows"] == 0:
                break
        time.sleep(0.1)
    query.stop()
    return done


def test_index_stream_goes_on(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    made = lambda: capture_index.stream(spark, str(tmp_path / "calls"), ["a.org/*", "b.org/*"], 1000.0, Logged)
    first = drained(made(), str(tmp_path / "out"), str(tmp_path / "c"), 2)
    assert len(first) >= 2
    drained(made(), str(tmp_path / "out"), str(tmp_path / "c"))
    rows = spark.read.parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).collect()
    want = Counter((p, n, f"https://{p[:5]}/{n}/{i}") for p, k in (("a.org/*", 6), ("b.org/*", 2)) for n in range(k) for i in range(1, 4))
    assert Counter((r.pattern, r.page, r.original) for r in rows) == want
    calls = Counter(f.name.rsplit("-", 1)[0] for f in (tmp_path / "calls").iterdir())
    assert set(calls) == {f"a-{n}" for n in range(6)} | {"b-0", "b-1"}
    # at most the page that was under way when the stream stopped is asked for again
    assert sum(calls.values()) <= 8 + 2


def test_pages_of_an_index(tmp_path):
    import hashlib

    folder = tmp_path / hashlib.sha256(b"x.org/*").hexdigest()[:16]
    folder.mkdir()
    (folder / "_.json").write_text(json.dumps([list(capture_index.FIELDS), capture("x.org", 0, 1), [], ["org,x)/", "2020"]]))
    (folder / "org,x)").mkdir()
    assert capture_index.parsed_page([]) == ([], "") and capture_index.parsed_page([[]]) == ([], "")
    (folder / "k.json").write_text(json.dumps([capture("x.org", 1, 1), []]))
    page = capture_index.stored_pages(str(tmp_path))
    assert capture_index.parsed_page(page("x.org/*", "")) == ([capture("x.org", 0, 1)], "org,x)/,2020")
    assert list(capture_index.scan(lambda p, k: page(p, "k"), "x.org/*")) == [capture("x.org", 1, 1)]
    assert page("none", "") == []


def state(data):
    return f'<html><template id="HH-Lux-InitialState">{html.escape(json.dumps(data, ensure_ascii=False))}</template></html>'


def site(folder):
    """Two keywords: physics has three pages of which the last says so, chemistry ends with an empty page; posting 3 is in
    both, posting 7's own page fails."""
    pages = {"физика": [[1, 2, 3], [4, 5], [6]], "chem": [[3, 7], []]}

    def fetch(address):
        (Path(folder) / f"{hash(address)}-{time.monotonic_ns()}").write_text(address)
        if "/search/" in address:
            from urllib.parse import parse_qs, urlparse

            asked = parse_qs(urlparse(address).query)
            keyword, n = asked["text"][0], int(asked["page"][0])
            items = [{"vacancyId": i, "name": f"item {i}", "publicationTime": {"$": "2021-02-03T00:00:00"}} for i in pages[keyword][n]]
            search = {"vacancies": items, "totalResults": 9, "paging": {"next": {"disabled": n == 2}}}
            return 200, "text/html", state({"vacancySearchResult": search})
        i = int(address.rsplit("/", 1)[1])
        if i == 7:
            return 404, "text/html", ""
        view = {
            "name": f"Posting {i}" + " стажёр" * (i == 5), "description": "<p>Опыт <b>работы</b></p>", "company": {"name": "C"}, "area": {"name": "A"}, "publicationDate": "2020-01-01",
            "compensation": {"from": 10 * i, "to": None, "currencyCode": "RUR"}, "keySkills": {"keySkill": ["python", "sql"]}, "workExperience": "noExperience", "professionalRoleIds": [96],
        }
        return 200, "text/html", state({"vacancyView": view})

    return fetch


def test_search_leads_to_postings(spark, tmp_path):
    keywords = spark.createDataFrame([("физика",), ("chem",), ("",), ("chem",)], "keyword string")
    found = crawl.searched(keywords, "https://s.org", crawl.by_transport(site(str(tmp_path)), tries=1))
    rows = found.collect()
    assert Counter(r.address for r in rows if r.kind == "detail") == Counter(f"https://s.org/vacancy/{i}" for i in range(1, 8))
    assert len([r for r in rows if r.kind == "search"]) == 5 and max(r.generation for r in rows) == 3
    calls = Counter(f.read_text() for f in tmp_path.iterdir())
    assert set(calls.values()) == {1} and len(calls) == 12  # each address once
    got = {r.id: json.loads(r.data) for r in crawl.postings(found, ["Стажёр"]).collect()}
    assert sorted(got) == ["1", "2", "3", "4", "6", "7"]
    one = got["2"]
    assert one["name"] == "Posting 2" and one["description"] == "Опыт работы" and one["salary"] == {"from": 20, "to": None, "currency": "RUR"}
    assert one["experience"] == {"name": "Нет опыта"} and one["key_skills"] == [{"name": "python"}, {"name": "sql"}] and one["professional_roles"] == [{"id": 96, "name": ""}]
    assert got["7"]["name"] == "item 7" and got["7"]["published_at"] == "2021-02-03T00:00:00" and got["7"]["description"] is None
    none = crawl.searched(keywords.limit(0), "https://s.org", crawl.by_transport(site(str(tmp_path)), tries=1))
    assert none.count() == 0 and crawl.postings(none).count() == 0
    few = crawl.searched(keywords.where("keyword = 'физика'"), "https://s.org", crawl.by_transport(site(str(tmp_path)), tries=1), 2)
    assert few.where(F.col("kind") == "search").count() == 2 and few.where(F.col("kind") == "detail").count() == 5


def test_search_pages_come_in_doubling_runs(spark, tmp_path, monkeypatch):
    from quillspark import stages
    from quillspark.plans import crawl as plans, registry
    from tests.oracle import compared

    # one host of 60 search pages, one of whose three pages the second is empty, one that has a page twice
    long = [(i, f"http://long.org/{i}", "x" * (i % 7)) for i in range(60 * plans.LISTED)]
    gap = [(5000 + i * 3 + (2 if i % 2 else 0), f"http://gap.org/{i}", "yy") for i in range(2 * plans.LISTED + 1)]
    gap = [(i, url, page) for i, url, page in gap if i % 3 != 1]
    twice = [(9000, "https://twice.org/a?b", "zzz"), (9001, "https://twice.org/a?b", "z"), (9002, "no address", None)]
    spark.createDataFrame(long + gap + twice, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    steps, counted = [], stages.counted

    def noted(df, name, **sums):
        steps.append(name)
        return counted(df, name, **sums)

    monkeypatch.setattr(stages, "counted", noted)
    n = compared(spark, registry.queries()["site_crawl"], registry.oracle_sql()["site_crawl"], str(tmp_path))
    assert n >= len(long) and len(steps) <= 20, (n, steps)
