"""Records of several sources in one canonical shape: field maps, validation and enrichment.

A source is a table of aliases: for each canonical field the JSON paths to try in order. All maps are column
expressions over one JSON string column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators.store import errors

# Field names of the sources.
ALIASES: dict[str, dict[str, list[str]]] = {
    "wayback-hhru": {
        "id": ["id"], "name": ["name"], "description": ["description"], "employer": ["employer.name", "employer"], "area": ["area.name", "area"],
        "salary_from": ["salary.from"], "salary_to": ["salary.to"], "currency": ["salary.currency"], "published_at": ["published_at"],
        "skills": ["key_skills"], "url": ["source_url"],
    },
    "wayback-linkedin": {
        "id": ["id"], "name": ["name", "title"], "description": ["description"], "employer": ["employer.name", "employer"], "area": ["area.name", "area"],
        "salary_from": ["salary.from"], "salary_to": ["salary.to"], "currency": ["salary.currency"], "published_at": ["published_at"],
        "skills": ["key_skills"], "url": ["source_url"], "industry": ["industry"],
    },
    "trudvsem": {
        "id": ["id", "vacancy_id"], "name": ["job-name", "vacancy_name", "name"], "description": ["vacancy_description", "description"],
        "requirements": ["requirements"], "duty": ["duty"], "employer": ["company.name", "company_name"], "area": ["region.name", "region_name"],
        "salary_from": ["salary_min"], "salary_to": ["salary_max"], "currency": ["salary_currency"],
        "published_at": ["creation-date", "creationDate", "creation_date"], "skills": ["skills", "key_skills"], "url": ["vac_url", "url", "source_url"],
        "role": ["category.specialisation"],
    },
    "rostud": {
        "id": ["id"], "name": ["Должность", "position", "name"], "description": ["Описание", "description"],
        "employer": ["Работодатель", "employer", "company"], "area": ["Регион", "region", "location"], "skills": ["key_skills"], "url": ["url", "source_url"],
    },
    "telegram": {
        "name": ["name"], "description": ["description"], "employer": ["employer.name", "employer"], "area": ["area.name", "area"],
        "salary_from": ["salary.from"], "salary_to": ["salary.to"], "currency": ["salary.currency"], "published_at": ["published_at"],
        "skills": ["key_skills"], "url": ["_source_url"],
    },
}
# Where a job's number stands in a network's addresses.
NETWORK_JOB = r"/jobs2?/view/(?:[^/]+-)?(\d+)"
REQUIREMENTS, DUTIES = "Требования: ", "Обязанности: "


def _path(raw: Column, path: str) -> Column:
    found = F.get_json_object(raw, "$" + "".join(f"['{p}']" for p in path.split(".")))
    return F.when(~found.startswith("{"), F.nullif(found, F.lit("")))


def _skills(raw: Column, paths: list[str]) -> Column:
    """Names of a list of strings or of objects with a name."""
    out = F.lit(None).cast("array<string>")
    for p in paths:
        text = F.get_json_object(raw, f"$['{p}']")
        each = F.from_json(text, "array<string>")
        out = F.coalesce(out, F.transform(each, lambda x: F.coalesce(F.when(x.startswith("{"), F.get_json_object(x, "$.name")), x)))
    return F.filter(F.coalesce(out, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def mapped(rows: DataFrame, source: str, raw: str = "raw", capture: str = "capture_ts") -> DataFrame:
    """id, name, ... of rows whose `raw` is a record of the source; an envelope {"vacancy": ...} is opened."""
    opened = rows.withColumn("__r", F.coalesce(F.get_json_object(raw, "$.vacancy"), F.col(raw)))
    r, names = F.col("__r"), ALIASES[source]
    get = lambda f: F.coalesce(*[_path(r, p) for p in names[f]], F.lit(None).cast("string")) if f in names else F.lit(None).cast("string")
    url, number = get("url"), get("id")
    if source == "wayback-hhru":
        key = F.coalesce(number, tx.first(url, r"/vacancy/(\d+)"), url)
    elif source == "wayback-linkedin":
        key = F.coalesce(number, F.concat(F.lit("linkedin-"), F.coalesce(tx.first(url, NETWORK_JOB), url)))
    elif source == "trudvsem":
        key = F.concat(F.lit("trudvsem-"), number)
    elif source == "telegram":
        key = F.concat(F.lit("telegram-"), F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(url, r"t\.me/([^/]+/\d+)", 1), "/", "-"), F.lit("")), url))
    else:
        key = F.coalesce(number, F.sha2(F.concat_ws("|", get("name"), get("employer"), F.col(capture)), 256))
    description = get("description")
    if source == "trudvsem":
        parts = F.concat_ws("\n", F.concat(F.lit(REQUIREMENTS), get("requirements")), F.concat(F.lit(DUTIES), get("duty")))
        description = F.coalesce(description, F.nullif(parts, F.lit("")))
    elif source == "wayback-linkedin":
        description = F.coalesce(F.concat(F.lit("[Industry: "), get("industry"), F.lit("]\n"), description), description)
    low, high = get("salary_from").cast("double").cast("int"), get("salary_to").cast("double").cast("int")
    currency = F.coalesce(get("currency"), F.lit("RUR")) if source == "trudvsem" else get("currency")
    return opened.select(
        key.alias("id"),
        F.coalesce(get("name"), F.lit("")).alias("name"),
        description.alias("description"),
        F.struct(get("employer").alias("name")).alias("employer"),
        F.struct(get("area").alias("name")).alias("area"),
        F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("from"), high.alias("to"), currency.alias("currency"))).alias("salary"),
        tx.iso_date(get("published_at")).alias("published_at"),
        F.transform(_skills(r, names["skills"]), lambda s: F.struct(s.alias("name"))).alias("key_skills"),
        F.when(get("role").isNotNull(), F.array(F.struct(F.lit(0).alias("id"), get("role").alias("name")))).otherwise(F.array().cast("array<struct<id:int,name:string>>")).alias("professional_roles"),
        F.lit(source).alias("_source"),
        F.col(capture).alias("_capture_ts"),
        url.alias("_original_url"),
    )


def enriched(rows: DataFrame) -> DataFrame:
    """With the year (of publication, else of capture), experience and education found in the description."""
    return rows.withColumns(
        {
            "year": F.coalesce(tx.leading_year(F.col("published_at")), tx.leading_year(F.col("_capture_ts"))),
            "experience_years": tx.experience_years(F.col("description")),
            "education": tx.education_level(F.col("description")),
        }
    )


def validated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that may be stored, and the others with the names of the checks they fail."""
    checks = {
        "id": F.coalesce("id", F.lit("")) != "",
        "name": F.trim("name") != "",
        "source": F.col("_source").isin(*ALIASES),
        "url": F.col("_original_url").isNull() | F.col("_original_url").rlike("^https?://"),
        "capture": F.col("_capture_ts").isNull() | F.col("_capture_ts").rlike(r"^\d{14}$"),
    }
    checked = rows.withColumn("errors", errors(checks))
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def unified(frames: list[DataFrame]) -> DataFrame:
    """All sources in one table."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def messages(rows: DataFrame, text: str = "text") -> DataFrame:
    """title, employer, area and salary of channel messages by labels at line starts; else the first line is the title."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    label = lambda names: F.nullif(F.regexp_extract(F.col(text), rf"(?imu)^\s*(?:{names})\s*[:–—-]\s*(.+?)\s*$", 1), F.lit(""))
    tagged = F.nullif(F.regexp_extract(F.col(text), r"(?imu)^\s*#(?:вакансия|vacancy|job)\s+(.+?)\s*$", 1), F.lit(""))
    plain = F.filter(lines, lambda x: ~x.startswith("#"))
    return rows.withColumns(
        {
            "title": F.coalesce(label("должность|вакансия|позиция|position|vacancy"), tagged, F.try_element_at(plain, F.lit(1)), F.lit("")),
            "employer": label("компания|работодатель|company|employer"),
            "area": label("город|регион|локация|location|city"),
            "salary": tx.salary(F.coalesce(label("зарплата|зп|оплата|salary"), F.lit(""))),
        }
    )


def archive_rows(rows: DataFrame, fields: str = "fields") -> DataFrame:
    """Captures of an archive index from positional lists; the header row goes, empty values are null."""
    names = ("timestamp", "original", "mimetype", "statuscode", "digest", "length")
    at = lambda i: F.nullif(F.try_element_at(F.col(fields), F.lit(i + 1)), F.lit(""))
    decoded = rows.select(*[at(i).alias(n) for i, n in enumerate(names)])
    return decoded.where("timestamp is not null and timestamp <> 'timestamp'")


# Experience codes and their labels.
EXPERIENCE_LABELS = {"noExperience": "Нет опыта", "between1And3": "От 1 года до 3 лет", "between3And6": "От 3 до 6 лет", "moreThan6": "Более 6 лет"}


def experience_label(code: Column) -> Column:
    """The label of an experience code; null for another."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXPERIENCE_LABELS.items() for x in kv]), code)


def publication_day(value: Column) -> Column:
    """A date as text, whether written plainly or as an object with $date."""
    return F.coalesce(F.get_json_object(value, "$['$date']"), value)


def valid_roles(roles: Column) -> Column:
    """The roles of a JSON list whose id is a whole number and whose name isn't empty, as {id, name}."""
    parsed = F.from_json(roles, "array<struct<id: string, name: string>>")
    typed = F.transform(F.coalesce(parsed, F.array()), lambda r: F.struct(r["id"].try_cast("int").alias("id"), r["name"].alias("name")))
    return F.filter(typed, lambda r: r["id"].isNotNull() & (F.trim(r["name"]) != ""))
