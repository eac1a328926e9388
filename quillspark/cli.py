"""Commands: queries by name, the phases one by one or all, collection and its ledger, census and reports.

Phases meet in tables under the warehouse of the configuration, so each can be run again by itself.
"""

from __future__ import annotations

import argparse
import json
import logging
import logging.handlers
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark import config as settings
from quillspark import stages
from quillspark.operators import axes, store
from quillspark.plans import phases, registry
from quillspark.sources import archive, crawl, keyed, mappers, open_data, readers, reports
from quillspark.sources import collect as collecting

log = logging.getLogger("quillspark")


def logged(path: str | None) -> None:
    """Messages go to the console, and to a file that is begun anew at 5 MB where one is named."""
    handlers: list[logging.Handler] = [logging.StreamHandler()]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.handlers.RotatingFileHandler(path, maxBytes=5 << 20, backupCount=3, encoding="utf-8"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s", handlers=handlers, force=True)


class Run:
    """One call of the program: its session, configuration and arguments."""

    def __init__(self, spark: SparkSession, conf: settings.Config, given: argparse.Namespace):
        self.spark, self.conf, self.given = spark, conf, given

    def table(self, name: str) -> DataFrame:
        return readers.parquet(self.spark, self.conf.path(name))

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        readers.write_parquet(df, self.conf.path(name))
        return self.table(name)

    def stem(self) -> DataFrame:
        return self.table("classified").where("stem_category = 'STEM_RESEARCH'")


def classify(run: Run) -> None:
    rows = run.keep("classified", phases.classified(readers.parquet(run.spark, run.given.records), run.conf))
    rows.groupBy("stem_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "stem_category").show(truncate=False)


def extract_skills(run: Run) -> None:
    run.keep("extracted_skills", phases.skills(run.stem(), run.conf)).agg(F.count("*").alias("pairs"), F.count_distinct("skill_phrase").alias("skills")).show()


def roles(run: Run) -> None:
    named, found = phases.roles(run.stem(), run.conf)
    run.keep("titles", named)
    run.keep("roles", found).select("role", "member_count").orderBy(F.desc("member_count"), "role").show(50, truncate=60)


def skills(run: Run) -> None:
    run.keep("skills_per_role", phases.skills_per_role(run.table("extracted_skills"), run.stem(), run.table("titles"))).groupBy("role").count().show(50, truncate=60)


def characteristics(run: Run) -> None:
    scores = run.keep("characteristic_scores", phases.axis_scores(run.table("skills_per_role"), readers.parquet(run.spark, run.given.glossary)))
    scores.groupBy("axis").agg(F.round(F.avg("proficiency"), 4).alias("mean")).orderBy("axis").show()


def soft(run: Run) -> None:
    found = run.keep("soft_scores", axes.rubric_scores(run.table("characteristic_scores"), axes.SOFT))
    found.groupBy("role").pivot("soft", list(axes.SOFT)).agg(F.round(F.first("proficiency"), 2)).orderBy("role").show(50, truncate=40)


def model(run: Run) -> None:
    built = phases.models(run.table("characteristic_scores"), run.table("roles"), run.table("skills_per_role"), run.conf)
    readers.write_documents(built, run.conf.path("models"), "role")


def validate(run: Run) -> None:
    found = phases.validation(run.table("classified"), run.table("roles"), run.table("characteristic_scores"))
    reports.write_json(found, f"{run.conf.path('reports')}/metrics.json", datetime.now(UTC).isoformat())
    print(phases.markdown([(r.metric, r.value) for r in found.collect()]))


def everything(run: Run) -> None:
    for step in (classify, extract_skills, roles, skills, characteristics, soft, model, validate):
        log.info("%s", step.__name__)
        step(run)


LEDGER = "run_id string, source string, params string, fetched long, stored long, at string, state string"


def noted(run: Run, run_id: str, source: str, state: str, params: str | None = None, fetched: int | None = None, stored: int | None = None) -> None:
    """One more event of a run in the ledger, which is only appended to (see store.ledger_state)."""
    event = [(run_id, source, params, fetched, stored, datetime.now(UTC).isoformat(), state)]
    run.spark.createDataFrame(event, LEDGER).coalesce(1).write.mode("append").parquet(run.conf.path("runs"))


def run_id(name: str, at: datetime | None = None) -> str:
    """The name in lower case, white space as _, and the time."""
    return f"{'_'.join(name.lower().split())}-{at or datetime.now(UTC):%Y%m%d%H%M%S}"


def kept(run: Run, source: str, rows: DataFrame, params: dict) -> tuple[int, int]:
    """Brings rows (id, data) into the store, where new ids alone come in; gives how many were fetched and stored. The
    run's start, finish and both counts are noted in the ledger; a run that ended early has a start alone."""
    name = getattr(run.given, "run", None) or run_id(source)
    noted(run, name, source, "started", json.dumps(params, ensure_ascii=False))
    now = datetime.now(UTC).isoformat()
    # fetched once: what comes is written before it is counted, compared and stored
    found, seen = stages.counted(rows.select("id", F.lit(name).alias("run_id"), F.lit(now).alias("fetched_at"), "data"), "collected")
    stored = keyed.insert(found, run.conf.path("raw"), "id", "fetched_at")
    noted(run, name, source, "finished", None, seen["n"], stored)
    print(f"{source}: {seen['n']} records fetched, {stored} stored")
    return seen["n"], stored


_listed = lambda x: [k for k in (x or "").split(",") if k]


def collect(run: Run) -> None:
    """Open data into the store."""
    rows = open_data.collected(run.spark, run.given.folder, _listed(run.given.texts), _listed(run.given.regions), **({"split": "always"} if run.given.all_regions else {}))
    if run.given.dry_run:
        print(f"{rows.count()} records")
        return
    kept(run, "trudvsem", rows, {k: v for k, v in vars(run.given).items() if k in ("folder", "texts", "regions", "all_regions")})


def archive_year(run: Run) -> None:
    """A source's captures of the years in the archive into the store, from stored answers of the index and of pages."""
    captures = archive.index_responses(run.spark, run.given.index)
    for year in range(run.given.first, (run.given.last or run.given.first) + 1):
        if run.given.source == "wayback-linkedin" and archive.era_pattern(year) is None:
            print(f"{run.given.source} {year}: no captures in these years")
            continue
        found, rows = collecting.archived(captures, run.given.source, year, archive.stored(run.given.pages), passes=run.given.passes, tries=1)
        errors = {r.error: r.n for r in archive.error_counts(found).collect() if r.error != "none"}
        kept(run, run.given.source, rows, {"year": year, "errors": errors})


def bulk(run: Run) -> None:
    """A folder of CSV tables into the store."""
    kept(run, "rostud", collecting.bulk(run.spark, run.given.folder, f"{datetime.now(UTC):%Y%m%d%H%M%S}"), {"folder": run.given.folder})


def channel(run: Run) -> None:
    """Exported messages of channels into the store."""
    rows = open_data.channel_messages(run.spark, run.given.folder, _listed(run.given.keywords), run.given.most or None)
    kept(run, "telegram", collecting.channel(rows, f"{datetime.now(UTC):%Y%m%d%H%M%S}"), {"folder": run.given.folder, "keywords": run.given.keywords})


def search(run: Run) -> None:
    """A site's search for keywords into the store, each keyword a run of its own, from stored answers."""
    words = _listed(run.given.keywords)
    asked = run.spark.createDataFrame([(w,) for w in words], "keyword string")
    found = crawl.searched(asked, run.given.host, crawl.by_transport(archive.stored(run.given.pages), tries=1), run.given.most)
    rows = stages.written(crawl.postings(found, _listed(run.given.excluded)), "postings")
    for word in words:
        run.given.run = run_id(word)
        kept(run, "site", rows.where(F.col("keyword") == word), {"keyword": word, "host": run.given.host})


def backfill(run: Run) -> None:
    """Descriptions and key skills of stored records that lack them, from stored pages of postings, in passes."""
    schema = "id string, run_id string, fetched_at string, data string"
    left = readers.missing_descriptions(keyed.read(run.spark, run.conf.path("raw"), schema), most=run.given.most or None)
    wanted = stages.written(left.select("id", F.concat(F.lit(f"{run.given.host}/vacancy/"), "id").alias("address")), "missing")
    if run.given.dry_run:
        print(f"{wanted.count()} records without a description")
        return
    step = lambda rows: archive.asked(rows, archive.stored(run.given.pages), tries=1)
    found = archive.in_passes(wanted.select("address"), step, run.given.passes, ("failed", "missing", "type"))
    pages = found.join(wanted, "address").select("id", "html", "error", F.lit("detail").alias("kind"), F.lit("{}").alias("item"), F.lit("").alias("keyword"))
    fields = F.from_json("data", "description string, key_skills array<struct<name: string>>")
    filled = crawl.postings(pages).select("id", fields.alias("d")).where("d.description is not null").select("id", F.to_json("d").alias("patch"))
    merged = lambda held, changes: held.join(changes, "id", "left").withColumn("data", store.patched("data", "patch")).drop("patch")
    n = keyed.update(stages.written(filled, "filled"), run.conf.path("raw"), "id", schema, merged)
    print(f"{n} descriptions filled, {wanted.count() - n} left")


def report(run: Run) -> None:
    """The metrics of a run, its roles with their skills, and its models as one Markdown report and one JSON file."""
    metrics = phases.validation(run.table("classified"), run.table("roles"), run.table("characteristic_scores"))
    folder = run.conf.path("reports")
    made = datetime.now(UTC).isoformat()
    reports.write_json(metrics, f"{folder}/metrics.json", made)
    lists = readers.skill_lists(run.table("skills_per_role")).select("role", F.slice("skills", 1, run.conf.top_skills).alias("skills"))
    models = readers.documents(run.spark, run.conf.path("models"))
    sections = models.select("role", "member_count").join(lists, "role", "left").orderBy(F.desc("member_count"), "role").limit(run.given.most).collect()
    text = phases.markdown([(r.metric, r.value) for r in metrics.collect()], "Report") + "".join(
        f"\n## {r.role}\n\n- titles: {r.member_count}\n- skills: {', '.join(r.skills or [])}\n" for r in sections
    )
    Path(folder).mkdir(parents=True, exist_ok=True)
    (Path(folder) / "report.md").write_text(text, "utf-8")
    print(text)


def history(run: Run) -> None:
    """All collectors one after the other, each from its folder where one is given; the first that fails ends the run."""
    given = run.given
    if given.index and given.pages:
        for source, first, last in (("wayback-hhru", given.first, given.last), ("wayback-linkedin", max(given.first, archive.ERAS[0][0]), given.last)):
            run.given = argparse.Namespace(**vars(given) | {"source": source, "first": first, "last": last})
            archive_year(run)
    if given.open_data:
        run.given = argparse.Namespace(folder=given.open_data, texts="", regions="", all_regions=False, dry_run=False, run=None)
        collect(run)
    if given.bulk:
        run.given = argparse.Namespace(folder=given.bulk)
        bulk(run)
    run.given = given
    verify(run)


def verify(run: Run) -> None:
    rows = run.table("raw")
    store.field_presence(mappers.mapped(rows.select(F.col("data").alias("raw"), F.lit("").alias("capture_ts")), "trudvsem").select("id", "name", "description"), ["id", "name", "description"]).show()
    state = store.ledger_state(run.table("runs"), "run_id", "at")
    state.groupBy("source").agg(
        F.count("*").alias("runs"), F.count_if(F.col("state") == "finished").alias("finished"), F.sum("fetched").alias("fetched"), F.sum("stored").alias("stored")
    ).show()


def merge(run: Run) -> None:
    into, other = (readers.parquet(run.spark, p) for p in (run.given.into, run.given.other))
    order = [F.asc(c) for c in into.columns]
    fresh, seen = stages.counted(store.fresh(into, other, "id", order), "merged")
    readers.write_parquet(into.unionByName(fresh.select(*into.columns)), run.given.out)
    print(f"{seen['n']} records merged")


def census(run: Run) -> None:
    captures = archive.index_responses(run.spark, run.given.folder)
    rows = reports.census(captures.withColumn("source", F.lit(run.given.source)).withColumn("pattern", F.lit(run.given.pattern)).where(archive.matches(F.col("original"), run.given.pattern)))
    made = datetime.now(UTC).isoformat()
    print(reports.table(rows, made))
    if run.given.out:
        reports.write_json(rows, run.given.out, made)


def generate(run: Run) -> None:
    readers.write_parquet(readers.generated(run.spark, run.given.rows, run.given.seed), run.given.out)


def query(run: Run) -> None:
    df = registry.queries()[run.given.name](run.spark, run.given.folder)
    if run.given.out:
        readers.write_parquet(df, run.given.out)
    else:
        df.show(20, truncate=60)


#: Name, function, what it does, its arguments (an option with a default, or a name that must be given).
COMMANDS: list[tuple[str, Callable[[Run], None], str, list]] = [
    ("query", query, "run one query over a folder of tables", ["name", "folder", ("--out", None)]),
    ("classify", classify, "categories of canonical records", ["records"]),
    ("extract-skills", extract_skills, "skills of the research postings", []),
    ("roles", roles, "roles of their titles", []),
    ("skills", skills, "skills by role", []),
    ("characteristics", characteristics, "scores of roles on axes", ["glossary"]),
    ("soft", soft, "soft competences of roles", []),
    ("model", model, "models of roles as JSON documents", []),
    ("validate", validate, "metrics of a run", []),
    ("all", everything, "all phases in order", ["records", "glossary"]),
    ("collect", collect, "open data into the store", ["folder", ("--texts", ""), ("--regions", ""), ("--run", None), ("--all-regions", False), ("--dry-run", False)]),
    ("archive", archive_year, "captures of years into the store", ["source", "index", "pages", ("--first", 2010), ("--last", 0), ("--passes", 3), ("--run", None)]),
    ("bulk", bulk, "CSV tables into the store", ["folder", ("--run", None)]),
    ("channel", channel, "messages of channels into the store", ["folder", ("--keywords", ""), ("--most", 0), ("--run", None)]),
    ("search", search, "a site's search for keywords into the store", ["keywords", "host", "pages", ("--excluded", ""), ("--most", 1000)]),
    ("backfill", backfill, "descriptions that stored records lack", ["host", "pages", ("--passes", 3), ("--most", 0), ("--dry-run", False)]),
    ("history", history, "all collectors in order", [("--index", ""), ("--pages", ""), ("--open-data", ""), ("--bulk", ""), ("--first", 2010), ("--last", 2026), ("--passes", 3)]),
    ("report", report, "a run's metrics, roles and skills as a report", [("--most", 50)]),
    ("verify", verify, "fields of the store and totals of the ledger", []),
    ("merge", merge, "two stores into one", ["into", "other", "out"]),
    ("census", census, "captures of an archive by year", ["folder", "source", "pattern", ("--out", None)]),
    ("generate", generate, "made postings", ["out", ("--rows", 10_000), ("--seed", 42)]),
]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark")
    parser.add_argument("--config")
    parser.add_argument("--domain", default=None)
    parser.add_argument("--log", default=None, help="a file for messages")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    for name, _, says, arguments in COMMANDS:
        one = sub.add_parser(name, help=says)
        for a in arguments:
            if isinstance(a, str):
                one.add_argument(a)
            elif a[1] is False:
                one.add_argument(a[0], action="store_true")
            else:
                one.add_argument(a[0], default=a[1], type=int if isinstance(a[1], int) else str)
    given = parser.parse_args(argv)
    if given.command == "list":
        print("\n".join(sorted(registry.queries())))
        return 0
    logged(given.log)
    conf = settings.load(given.config)
    if given.domain:
        conf = settings.Config(**{**conf.__dict__, "domain": given.domain})
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    next(run for name, run, _, _ in COMMANDS if name == given.command)(Run(spark, conf, given))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
