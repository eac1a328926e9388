"""Scalar functions on text columns: clean-up, experience, education, dates, salaries, titles and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genitive Russian month names in order.
MONTHS = "января февраля марта апреля мая июня июля августа сентября октября ноября декабря".split()


def first(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match; null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def clean_html(html: Column) -> Column:
    """Tags become spaces, white space one space; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", " "), r"[\s\x{A0}]+", " ")), F.lit(""))


# The patterns of years of experience in order; the first group is a number, the second may be one.
EXPERIENCE = (
    r"опыт работы.*?(\d+)[-–]*(\d*)\s*(год|лет|года)",
    r"стаж работы.*?(\d+)[-–]*(\d*)\s*(год|лет|года)",
    r"опыт.*?от\s*(\d+)\s*(год|лет|года)",
    r"(\d+)[-–](\d+)\s*(год|лет|года).*?опыт",
    r"требуемый опыт.*?(\d+)[-–]*(\d*)\s*(год|лет|года)",
)
# Words that say that no experience is asked for, and the range of years.
NO_EXPERIENCE = ("нет опыта", "без опыта", "no experience", "entry level", "internship")
YEARS = r"(?iu)(?:от\s+|from\s+)?(\d+(?:\.\d+)?)\s*(?:[-–до]+\s*(\d+(?:\.\d+)?)\s*)?(?:год|лет|года|years?|yrs?|yr)"
# Patterns of education levels in order.
EDUCATION = (
    (r"(?i)доктор\s+наук", "doctor_of_sciences"),
    (r"(?i)кандидат\s+наук", "candidate_of_sciences"),
    (r"(?i)аспирант|аспирантур", "phd_student"),
    (r"(?i)магистр|магистратур|master", "masters"),
    (r"(?i)бакалавр|bachelor", "bachelors"),
    (r"(?i)высш[а-я]*\s*(?:образован|профессиональн)", "higher_education"),
    (r"(?i)неполное\s*высш", "incomplete_higher"),
    (r"(?i)средн[а-я]*\s*(?:специальн|профессиональн|техническ)", "secondary_vocational"),
    (r"(?i)средн[а-я]*\s*образован", "secondary"),
    (r"(?i)\bPhD\b|doctorate|doctoral", "doctorate"),
    (r"(?i)master'?s?\s*degree|M\.?Sc|M\.?A\.|MBA", "masters"),
    (r"(?i)bachelor'?s?\s*degree|B\.?Sc|B\.?A\.|undergraduate", "bachelors"),
    (r"(?i)associate'?s?\s*degree|A\.?A\.|A\.?S\.", "associates"),
    (r"(?i)high\s*school\s*diploma|GED", "high_school"),
)


def experience_years(text: Column) -> Column:
    """Years of experience: a range's mean, or one number; the first pattern that matches wins."""
    t, found = F.lower(text), []
    for pattern in EXPERIENCE:
        low, high = first(t, pattern, 1).cast("double"), first(t, pattern, 2)
        # the second group of a pattern without a range is the word for years, no number
        found.append(F.when(high.rlike(r"^\d+$"), (low + F.when(high.rlike(r"^\d+$"), high).cast("double")) / 2).otherwise(low))
    return F.coalesce(*found)


def experience_range(name: Column) -> Column:
    """{min, max} of a range of years; {0, 0} where no experience is asked for; null where nothing is said."""
    lower = F.lower(F.trim(name))
    none = None
    for words in NO_EXPERIENCE:
        hit = F.contains(lower, F.lit(words))
        none = hit if none is None else none | hit
    low, high = first(name, YEARS, 1).cast("double"), first(name, YEARS, 2).cast("double")
    pair = lambda a, b: F.struct(a.cast("double").alias("min"), b.cast("double").alias("max"))
    return F.when(none, pair(F.lit(0.0), F.lit(0.0))).when(low.isNotNull(), pair(low, high))


def education_level(text: Column) -> Column:
    """The first that matches of ordered levels."""
    out = F
    for pattern, name in EDUCATION:
        out = out.when(text.rlike(pattern.replace("(?i)", "(?iu)")), name)
    return out


def leading_year(text: Column) -> Column:
    return first(text, r"^\s*(\d{4})").cast("int")


def iso_date(text: Column) -> Column:
    """What begins as D.M.YYYY or 'D month YYYY' as an ISO date; other text trimmed."""
    t = F.trim(text)
    two = lambda c: F.lpad(c, 2, "0")
    dots = r"^(\d{1,2})\.(\d{1,2})\.(\d{4})"
    part = lambda i: F.regexp_extract(t, dots, i)
    dotted = F.when(t.rlike(dots), F.concat_ws("-", part(3), two(part(2)), two(part(1))))
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS, 1) for x in (m, f"{i:02d}")])
    month = F.try_element_at(names, first(F.lower(t), r"^\d{1,2}\s+(\p{L}+)\s+\d{4}"))
    worded = F.when(month.isNotNull(), F.concat_ws("-", first(t, r"(\d{4})"), month, two(first(t, r"^(\d{1,2})"))))
    return F.coalesce(dotted, worded, t)


# How amounts of money are written.
SIGN = r"(?:\$|USD\s*|€|EUR\s*|£|GBP\s*)"
AMOUNT = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*[Kk]?)"
BETWEEN = r"\s*(?:-|–|to|—)\s*"
HOURLY, YEAR_OF_HOURS = ("per hour", "/hr", "/hour"), 2080


def currency(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("руб"), "RUR").when(t.rlike(r"\$|usd"), "USD").when(t.rlike("€|eur"), "EUR").when(t.rlike("£|gbp"), "GBP")


def _amount(raw: Column) -> Column:
    """A written amount as a whole number (halves to even); K is a thousand."""
    bare = F.upper(F.trim(F.replace(raw, F.lit(","), F.lit(""))))
    value = F.trim(F.rtrim(bare, F.lit("K"))).try_cast("double")
    return F.rint(value * F.when(bare.endswith("K"), 1000).otherwise(1)).try_cast("int")


def _russian_salary(t: Column) -> tuple[Column, Column]:
    """Numbers with spaces in them: of several the least and greatest; one counts by its 'от' or 'до'."""
    spaced = F.regexp_extract_all(t, F.lit(r"(?U)(\d[\d\s\x{A0}]*\d|\d+)"), 1)
    numbers = F.array_compact(F.transform(spaced, lambda x: F.regexp_replace(x, r"[ \x{A0}]", "").try_cast("int")))
    upto = F.contains(F.lower(t), F.lit("до")) & ~F.contains(F.lower(t), F.lit("от"))
    one = F.size(numbers) == 1
    low, high = F.array_min(numbers), F.array_max(numbers)
    return F.when(~(one & upto), low), F.when(~one | upto, high)


def _english_salary(t: Column) -> tuple[Column, Column]:
    """A range; else an amount with a currency before it; else an hourly rate as a year's."""
    spread = f"{SIGN}?\\s*{AMOUNT}{BETWEEN}{SIGN}?\\s*{AMOUNT}"
    single = first(t, f"{SIGN}\\s*{AMOUNT}")
    hourly = F.lit(False)
    for word in HOURLY:
        hourly = hourly | F.contains(F.lower(t), F.lit(word))
    rate = F.when(hourly, (_amount(first(t, r"(\d{1,4}(?:,\d{3})*(?:\.\d+)?)")).cast("long") * YEAR_OF_HOURS).try_cast("int"))
    both = lambda i: F.when(t.rlike(spread), _amount(F.regexp_extract(t, spread, i))).when(single.isNotNull(), _amount(single)).otherwise(rate)
    return both(1), both(2)


def salary(text: Column) -> Column:
    """from, to, currency of a text about pay: Russian where it says руб, от or до, else English."""
    t = F.trim(text)
    low = F.lower(t)
    russian = F.contains(low, F.lit("руб")) | F.contains(low, F.lit("от")) | F.contains(low, F.lit("до"))
    (ru_from, ru_to), (en_from, en_to) = _russian_salary(t), _english_salary(t)
    return F.struct(F.when(russian, ru_from).otherwise(en_from).alias("from"), F.when(russian, ru_to).otherwise(en_to).alias("to"), currency(t).alias("currency"))


def title_or_start(title: Column, description: Column, most: int = 100) -> Column:
    """The trimmed title, else the beginning of the description cut at its last space."""
    start = F.substring(F.trim(description), 1, most)
    cut = F.when(F.length(F.trim(description)) > most, F.coalesce(first(start, r"(?s)^(.*) "), start)).otherwise(start)
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), F.nullif(cut, F.lit("")))


def url_id(url: Column) -> Column:
    """The number in a posting's address."""
    return F.coalesce(first(url, r"/vacancy/(\d+)"), first(url, r"/(\d+)(?:[/?#.]|$)"), first(url, r"[?&]id=(\d+)"))


def bin_label(value: Column, edges: list[int]) -> Column:
    """'lo–hi' of the bin that holds the value, 'last+' from the last edge on; null below the first."""
    out = None
    for lo, hi in zip(edges, edges[1:]):
        label = F.when((value >= lo) & (value < hi), f"{lo}–{hi}")
        out = label if out is None else out.when((value >= lo) & (value < hi), f"{lo}–{hi}")
    return out.when(value >= edges[-1], f"{edges[-1]}+")


def years_word(n: Column) -> Column:
    """The Russian word for 'years' that agrees with n."""
    return (
        F.when((n % 10 == 1) & (n % 100 != 11), "год")
        .when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "года")
        .otherwise("лет")
    )


def cache_key(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def phrases(text: Column, most: int = 4) -> Column:
    """Lower, trimmed phrases of a comma list, of one to `most` words, in order and once."""
    parts = F.transform(F.split(F.lower(text), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (F.size(F.split(x, r"\s+")) <= most)))
