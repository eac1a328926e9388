"""Readers and writers of the file formats, the archive of saved pages as a data source, and generated postings."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def json_lines(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def csv_folder(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def excel(spark: SparkSession, path: str) -> DataFrame:
    """A workbook's first sheet, read on the driver; needs an Excel engine of pandas."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path))


def optional(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or an empty one of the schema where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_parquet(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str, key: str) -> None:
    """Nested documents in a folder per key."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def documents(spark: SparkSession, path: str, key: str = "role") -> DataFrame:
    """What `write_documents` wrote: one row for each document, with its key."""
    return spark.read.option("basePath", path).json(path).where(F.col(key).isNotNull())


def skill_lists(role_skills: DataFrame, by: str = "tfidf_weight") -> DataFrame:
    """role, skills: the names of each role's skills, the heaviest first, then by name."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col(by)).alias("order"), "skill")))
    return role_skills.groupBy("role").agg(ordered.alias("l")).select("role", F.transform("l", lambda s: s["skill"]).alias("skills"))


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric, value of a JSON report of metrics; none where there is no report."""
    try:
        report = spark.read.option("multiLine", True).schema("results array<struct<metric: string, value: double>>").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "metric string, value double")
    return report.select(F.inline("results")).where("metric is not null")


def schema_errors(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """What is wrong with a frame's columns: those that lack, and those whose type doesn't begin as wanted."""
    kinds = dict(df.dtypes)
    return [f"missing column: {c}" for c in wanted if c not in kinds] + [f"column {c}: {kinds[c]}, not {t}" for c, t in wanted.items() if c in kinds and not kinds[c].startswith(t)]


def column_differences(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """The wanted columns that a frame lacks, and its columns that aren't wanted, both in order."""
    return [c for c in wanted if c not in df.columns], [c for c in df.columns if c not in set(wanted)]


def first_value(value: Column) -> Column:
    """The first of a list as text; null for an empty one."""
    return F.try_element_at(value, F.lit(1)).cast("string")


def missing_descriptions(rows: DataFrame, data: str = "data", key: str = "id", most: int | None = None) -> DataFrame:
    """Raw records without a description: all of them, or the first `most` by key."""
    found = F.get_json_object(data, "$.description")
    left = rows.where(F.coalesce(F.length(found), F.lit(0)) == 0)
    return left if most is None else left.orderBy(key).limit(most)


def weeks(spark: SparkSession, year: int) -> DataFrame:
    """start, end of windows of seven days over a year, the last cut at its end."""
    days = F.explode(F.sequence(F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year), F.lit(12), F.lit(31)), F.expr("interval 7 days")))
    return spark.range(1).select(days.alias("start")).withColumn("end", F.least(F.date_add("start", 6), F.make_date(F.lit(year), F.lit(12), F.lit(31))))


class SavedPages(DataSource):
    """Format `saved_pages`: path, html of the pages under a folder that driver and executors share; a partition a folder.

    Options: path, and pattern (default *.html).
    """

    @classmethod
    def name(cls) -> str:
        return "saved_pages"

    def schema(self) -> str:
        return "path string, html string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _SavedPagesReader(self.options)


class _Folder(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _SavedPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.pattern = options["path"], options.get("pattern", "*.html")

    def partitions(self) -> list[InputPartition]:
        root = Path(self.root)
        return [_Folder(str(p)) for p in sorted({f.parent for f in root.rglob(self.pattern)})] or [_Folder(str(root))]

    def read(self, partition: _Folder):
        for f in sorted(Path(partition.path).glob(self.pattern)):
            yield str(f), f.read_text("utf-8", "replace")


# Parts of generated postings.
TITLES = ("инженер", "исследователь", "аналитик данных", "лаборант", "программист", "технолог", "руководитель группы")
SKILLS = ("python", "статистика", "спектроскопия", "машинное обучение", "английский язык", "моделирование", "управление проектами", "sql", "хроматография")


def generated(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """Postings with a title, three to six skills, years of experience and a year, the same for a seed."""
    pick = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    titles, skills = F.array(*[F.lit(t) for t in TITLES]), F.array(*[F.lit(s) for s in SKILLS])
    ranked = F.transform(skills, lambda s: F.struct(F.xxhash64("id", F.lit(seed), s).alias("h"), s.alias("s")))
    return spark.range(rows).select(
        F.concat(F.lit("gen-"), F.col("id").cast("string")).alias("vacancy_id"),
        F.element_at(titles, pick(len(TITLES), "title") + 1).alias("title"),
        F.transform(F.slice(F.array_sort(ranked), 1, pick(4, "n") + 3), lambda x: x["s"]).alias("skills"),
        F.when(pick(5, "none") > 0, pick(16, "years").cast("double")).alias("experience_years"),
        (pick(10, "year") + 2015).alias("year"),
    )
