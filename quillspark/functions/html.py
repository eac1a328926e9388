"""Fields of saved posting pages: a small element tree on the standard library, CSS-like selectors, and page layouts.

A layout lists for each field the selectors to try in order; adding a site means adding a layout.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.functions.text import salary

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_STEP = re.compile(r"""^([a-zA-Z][\w-]*)?((?:\.[\w-]+|\[[^\]]+\])*)$""")
_TEST = re.compile(r"""\.([\w-]+)|\[([\w-]+)(?:(\*?=)["']?([^"'\]]*)["']?)?\]""")


@dataclass
class Element:
    tag: str
    attributes: dict[str, str]
    parent: Element | None = None
    children: list[Element | str] = field(default_factory=list)

    def walk(self):
        for c in self.children:
            if isinstance(c, Element):
                yield c
                yield from c.walk()

    def strings(self):
        for c in self.children:
            if isinstance(c, str):
                yield c
            elif c.tag not in ("script", "style"):
                yield from c.strings()

    def text(self) -> str | None:
        return " ".join(" ".join(self.strings()).split()) or None


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", {})

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(e)
        if tag not in _VOID:
            self.at = e

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.tag != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str | None) -> Element:
    builder = _Builder()
    builder.feed(page or "")
    builder.close()
    return builder.root


def matches(e: Element, selector: str) -> bool:
    """tag, .class, [attribute], [attribute=value] and [attribute*=part], together."""
    step = _STEP.match(selector)
    if not step or (step[1] and e.tag != step[1].lower()):
        return False
    for name, attribute, kind, value in _TEST.findall(step[2] or ""):
        if name:
            if name not in e.attributes.get("class", "").split():
                return False
        elif attribute not in e.attributes:
            return False
        elif kind == "=" and e.attributes[attribute] != value or kind == "*=" and value not in e.attributes[attribute]:
            return False
    return True


def select(root: Element, selector: str) -> list[Element]:
    return [e for e in root.walk() if matches(e, selector)]


def first_text(root: Element, selectors: list[str]) -> str | None:
    """The text, or the content attribute of a meta element, of the first selector that finds one."""
    for s in selectors:
        for e in select(root, s):
            found = e.attributes.get("content") if e.tag == "meta" else e.text()
            if found:
                return found
    return None


def linked_data(root: Element) -> dict:
    """The first JSON object among the page's ld+json scripts."""
    for e in select(root, "script[type=application/ld+json]"):
        try:
            found = json.loads("".join(c for c in e.children if isinstance(c, str)))
        except ValueError:
            continue
        for x in found if isinstance(found, list) else [found]:
            if isinstance(x, dict):
                return x
    return {}


# The class names and attributes that the archived pages carry.
LAYOUTS: dict[str, dict[str, list[str]]] = {
    "board-legacy": {
        "name": ["div.vacancy-title", "h1"],
        "description": ["div.vacancy-description", "div.vacancy-content"],
        "employer": ["span.company-name", "a.company-link", "div.company-name"],
        "area": ["span.location", "div.location"],
        "salary_text": ["span.salary"],
        "date_text": ["span.vacancy-creation-date", "div.vacancy-creation-date", "meta[name=DC.date]"],
        "experience": ["span.experience", "div.experience"],
    },
    "board-modern": {
        "name": ["h1[data-qa=vacancy-title]"],
        "description": ["div[data-qa=vacancy-description]", "div.vacancy-branded-user-content", "ld:description", "div[class*=g-user-content]"],
        "employer": ["a[data-qa=vacancy-company-name]", "span[data-qa=vacancy-company-name]", "div[data-qa=vacancy-company-name]"],
        "area": ["p[data-qa=vacancy-view-location]", "span[data-qa=vacancy-view-raw-address]"],
        "salary_text": ["span[data-qa=vacancy-salary]", "p.vacancy-salary"],
        "date_text": ["p.vacancy-creation-time", "meta[itemprop=datePosted]", "ld:datePosted"],
        "experience": ["span[data-qa=vacancy-experience]"],
        "skills": ["[data-qa=skills-element]"],
        "schedule": ["p[data-qa=vacancy-view-employment-mode]"],
    },
    "network-legacy": {
        "name": ["h1.title", "h2.jobs-title", "h1.job-title", "h1[class*=title]"],
        "description": ["div.description", "div.job-description", "section.description", "div[class*=description]"],
        "employer": ["a.company-name-link", "span.company", "a[data-tn-element=companyName]", "a[class*=company]"],
        "area": ["span.location", "span.job-location", "div.location", "span[class*=location]"],
    },
    "network-modern": {
        "name": ["h1.topcard__title", "h1.top-card-layout__title", "h1[class*=title]", "ld:title"],
        "description": ["div.description__text", "div.show-more-less-html__markup", "section.description", "div[class*=description]", "ld:description"],
        "employer": ["a.topcard__org-name-link", "span.topcard__flavor", "a[class*=org-name]", "span[class*=company]", "ld:hiringOrganization.name"],
        "area": ["span.topcard__flavor--bullet", "span[class*=location]"],
        "date_text": ["ld:datePosted"],
    },
}
# What stands on a page behind a login, by layout; elsewhere GATES.
NETWORK_GATES = {
    "network-legacy": ["div.sign-in-modal", "div.login-form", "div.reg-upsell", "form.login"],
    "network-modern": ["div.sign-in-modal", "div.login-form", "div.reg-upsell", "form.login", "nav[id=global-nav][class*=signin]"],
}
SIGN_IN = ("h1", "h2")
# Where a network's pages have the date, and the criteria with their labels.
POSTED = {
    "network-legacy": ["span.posted-time", "span[class*=posted]", "time[datetime]"],
    "network-modern": ["span.posted-time-ago__text", "span[class*=time-ago]", "span[class*=posted-time]", "time[datetime]"],
}
CRITERIA = ["div.job-criteria", "section.job-criteria", "div[class*=job-criteria]", "div[class*=criteria]"]
CRITERION = ["li.description__job-criteria-item", "span.description__job-criteria-text", "span.job-criteria__text"]
LABELS = {
    "seniority level": "experience", "seniority": "experience", "experience": "experience", "experience level": "experience", "employment type": "schedule",
    "job function": "job_function", "functions": "job_function", "industry": "industry", "industries": "industry",
}
LABEL_WORDS = {"seniority": "experience", "experience": "experience", "employment": "schedule", "industry": "industry"}
IN_DESCRIPTION = {
    "experience": r"(?:Seniority\s*level|Experience\s*level|Seniority)[:\s-]+([^\n,]{3,40})",
    "industry": r"(?:Industry|Industries)[:\s-]+([^\n,]{3,60})",
}
GATES = ["form[class*=login]", "div[class*=authwall]"]
FIELDS = ("name", "description", "employer", "area", "salary_text", "date_text", "experience", "schedule", "industry", "job_function", "salary_currency")
PARSED = T.StructType(
    [T.StructField(n, T.StringType()) for n in FIELDS]
    + [T.StructField(n, T.LongType()) for n in ("salary_from", "salary_to")]
    + [T.StructField("skills", T.ArrayType(T.StringType())), T.StructField("gated", T.BooleanType())]
)


def _among(root: Element, selectors: list[str]) -> list[Element]:
    """The elements that one of the selectors matches, in the page's order."""
    return [e for e in root.walk() if any(matches(e, s) for s in selectors)]


def _later_siblings(e: Element, tags: tuple[str, ...]) -> list[Element]:
    own = [c for c in e.parent.children if isinstance(c, Element)] if e.parent else []
    return [c for c in own[next((i for i, c in enumerate(own) if c is e), len(own)) + 1 :] if c.tag in tags]


def labelled_values(section: Element) -> dict[str, str]:
    """What follows each label of a criteria list: an element whose whole text is a label (with a colon or without), and the
    next element beside it."""
    out: dict[str, str] = {}
    pairs = [(section_items, tags) for section_items, tags in ((("dt", "dd", "span", "div", "li"), ("dd", "span", "div", "li")), (("span[class*=criteria]",), ("span",)))]
    for selectors, tags in pairs:
        for e in _among(section, list(selectors)):
            key = LABELS.get((e.text() or "").lower().rstrip(":").strip())
            if key and key not in out and (beside := _later_siblings(e, tags)) and (value := beside[0].text()):
                out[key] = value
    return out


def inline_values(items: list[Element]) -> dict[str, str]:
    """The values of items that read `label: value`."""
    out: dict[str, str] = {}
    for e in items:
        text = e.text() or ""
        key = next((k for word, k in LABEL_WORDS.items() if word in text.lower() and k not in out), None)
        parts = re.split(r"[:–\n]", text, maxsplit=1)
        if key and len(parts) > 1 and parts[1].strip():
            out[key] = parts[1].strip()
    return out


def _listed(found: list[Element]) -> list[str]:
    return [t for e in found for item in select(e, "li") if (t := item.text())]


def _network_skills(root: Element, layout: str) -> list[str]:
    """Items of the lists under headings about skills, each once."""
    out: list[str] = []
    if layout == "network-legacy":
        out += [t for e in select(root, "span.job-criteria__text") if (t := e.text())]
        order = list(root.walk())
        for i, e in enumerate(order):
            if e.tag in ("h3", "h4", "strong", "b", "span", "div") and any(w in (e.text() or "").lower() for w in ("skills", "qualifications", "requirements")):
                out += _listed([next((x for x in order[i + 1 :] if x.tag in ("ul", "ol", "div")), Element("", {}))])
    else:
        for e in _among(root, ["h2", "h3", "h4", "strong", "b"]):
            if "skill" in (e.text() or "").lower() and e.parent is not None:
                out += _listed([e.parent, *_later_siblings(e.parent, ("div",))])
    return list(dict.fromkeys(out))


def _posted(root: Element, layout: str) -> str | None:
    """The date of the first element that has one: its attribute, or its text (of an old page one that says when it was
    posted, cut to a date that it holds)."""
    e = next(iter(_among(root, POSTED[layout])), None)
    if e is None or "datetime" in e.attributes:
        return e.attributes["datetime"] if e else None
    text = e.text()
    if layout == "network-legacy" and text:
        day = re.search(r"\d{4}-\d{2}-\d{2}", text)
        return None if "posted" not in text.lower() else day.group() if day else text
    return text


def _at(data: dict, path: str):
    for step in path.split("."):
        data = data.get(step) if isinstance(data, dict) else None
    return data


def _linked_salary(data: dict) -> dict:
    """from, to and currency of a posting's linked data, whose amounts lie one level deeper."""
    whole = lambda x: round(x) if isinstance(x, int | float) and not isinstance(x, bool) and x == x and abs(x) < 1e18 else None
    currency = _at(data, "baseSalary.currency")
    return {
        "salary_from": whole(_at(data, "baseSalary.value.minValue")), "salary_to": whole(_at(data, "baseSalary.value.maxValue")),
        "salary_currency": currency if isinstance(currency, str) else None,
    }


def _network_fields(root: Element, layout: str, out: dict, data: dict) -> None:
    out["date_text"] = _posted(root, layout) or out["date_text"]
    if layout == "network-modern":
        out.update(_linked_salary(data))
        found = inline_values(_among(root, CRITERION))
    else:
        section = next(iter(_among(root, CRITERIA)), None)
        found = labelled_values(section) if section else {}
    for key, pattern in IN_DESCRIPTION.items():
        if key not in found and (m := re.search(pattern, out["description"] or "", re.IGNORECASE)):
            found[key] = m.group(1).strip()
    out.update(found)
    out["skills"] = _network_skills(root, layout)
    if out["salary_from"] is None and out["description"]:
        out["salary_text"], out["salary_to"], out["salary_currency"] = out["description"], None, None


def parse_page(page: str | None, layout: str) -> dict:
    """The fields of a page by a layout; a page behind a login has none.

    A network's pages have criteria, lists of skills and linked data besides; where linked data have no least salary, the
    description stands as salary_text.
    """
    root, rules = tree(page), LAYOUTS[layout]
    gates = NETWORK_GATES.get(layout, GATES)
    signs = layout == "network-legacy" and any("sign in" in (e.text() or "").lower() for e in _among(root, list(SIGN_IN)))
    titles = [s for s in rules["name"] if not s.startswith("ld:")]
    gated = (signs or bool(_among(root, gates))) and not _among(root, titles) if layout in NETWORK_GATES else bool(_among(root, gates)) and not first_text(root, titles)
    out: dict = {n: None for n in PARSED.names} | {"skills": [], "gated": gated}
    if gated:
        return out
    data = linked_data(root)
    if layout == "network-modern" and data.get("@type") != "JobPosting":
        data = {}
    for name, selectors in rules.items():
        if name == "skills":
            out["skills"] = [t for s in selectors for e in select(root, s) if (t := e.text())]
            continue
        for s in selectors:
            found = _at(data, s[3:]) if s.startswith("ld:") else first_text(root, [s])
            if isinstance(found, str) and found:
                out[name] = tree(found).text() if s.startswith("ld:") else found
                break
    if layout in NETWORK_GATES:
        _network_fields(root, layout, out, data)
    return out


def posting_salary(parsed: Column) -> Column:
    """from, to, currency of a parsed page: its linked data's, else what its text says about pay."""
    said = salary(parsed["salary_text"])
    linked = F.struct(parsed["salary_from"].try_cast("int").alias("from"), parsed["salary_to"].try_cast("int").alias("to"), parsed["salary_currency"].alias("currency"))
    return F.when(parsed["salary_from"].isNull() & parsed["salary_text"].isNotNull(), said).otherwise(linked)


def parsed_pages(pages: DataFrame, layout: str, html: str = "html") -> DataFrame:
    """pages with a struct column `parsed`."""

    @F.pandas_udf(PARSED)
    def parse(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_page(t, layout) for t in texts], columns=PARSED.names)

    return pages.withColumn("parsed", parse(html))


def embedded_state(html, template: str = "InitialState"):
    """The JSON text that a page holds in a template element, with character references decoded."""
    raw = F.nullif(F.regexp_extract(html, rf'(?s)<template[^>]*id="[^"]*{template}"[^>]*>(.*?)</template>', 1), F.lit(""))
    for entity, plain in (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        raw = F.replace(raw, F.lit(entity), F.lit(plain))
    return raw
