"""Remembered scores and answers decoded in tiers: a second run asks nothing, broken answers fall back one by one."""

import hashlib
import json
import time
from collections import Counter
from pathlib import Path

from pyspark.sql import functions as F

from quillspark.operators import answers, characteristics


def calls(folder):
    return Counter(tuple(json.loads(f.read_text())) for f in Path(folder).iterdir())


def model(folder):
    """Answers by what the user's text says; each call leaves a file."""

    def ask(mode, system, user):
        nth = len([f for f in Path(folder).iterdir() if json.loads(f.read_text()) == [mode, user]])
        (Path(folder) / hashlib.md5(f"{mode}{user}{time.monotonic_ns()}".encode()).hexdigest()).write_text(json.dumps([mode, user]))
        good = json.dumps({"name": f"role of {user}", "rank": 3})
        if user == "down":
            raise OSError("no connection")
        if mode == "schema":
            return {"second": good if nth else "{", "object": "no json", "never": "?", "partial": '{"name": "x"}', "typed": '{"name": "x", "rank": "many"}'}.get(user, good)
        return {"never": "sorry, no", "typed": '{"name": "x", "rank": []}'}.get(user, f"Sure! Here it is: {good} - anything else?")

    return ask


def test_tiers_and_memory(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    users = ["plain", "plain", "second", "object", "never", "partial", "typed", "down", None]
    prompts = spark.createDataFrame([(i, "say", u) for i, u in enumerate(users)], "id long, system string, user string").repartition(3)
    run = lambda: {r.id: r.answer for r in answers.answered(prompts, model(str(tmp_path / "calls")), "name string, rank int", "role", "m1", str(tmp_path / "s")).collect()}
    got = run()
    assert {i: a and a.name for i, a in got.items()} == {0: "role of plain", 1: "role of plain", 2: "role of second", 3: "role of object", 4: None, 5: "role of partial", 6: None, 7: None, 8: "role of "}
    first = calls(tmp_path / "calls")
    assert first["schema", "plain"] == 1 and first["object", "plain"] == 0  # equal prompts are asked for once
    assert first["schema", "second"] == 2 and first["object", "second"] == 0
    assert first["schema", "object"] == 2 and first["object", "object"] == 1 and first["object", "never"] == 1
    assert run() == got
    more = calls(tmp_path / "calls") - first
    assert {u for _, u in more} == {"never", "typed", "down"}  # what has an answer isn't asked for again
    other = answers.answered(prompts.where("id = 0"), model(str(tmp_path / "calls")), "name string, rank int", "role", "m2", str(tmp_path / "s"))
    assert other.first().answer.rank == 3 and (calls(tmp_path / "calls") - first - more) == Counter({("schema", "plain"): 1})
    assert answers.answered(prompts.limit(0), model(str(tmp_path / "calls")), "name string, rank int", "role", "m1").count() == 0
    strict = answers.answered(prompts.where("id = 0"), model(str(tmp_path / "calls")), "name string, rank int", "role", "m1", valid=lambda s: s["rank"] > 5)
    assert strict.first().answer is None


def test_objects_in_texts(spark):
    rows = [("a {\"x\": {\"y\": 1}} b", '{"x": {"y": 1}}'), ("none", None), (None, None), ("{\n}", "{\n}")]
    df = spark.createDataFrame(rows, "t string, want string")
    assert df.where(~answers.object_in_text(F.col("t")).eqNullSafe(F.col("want"))).isEmpty()


def test_remembered_vectors(spark, tmp_path):
    (tmp_path / "calls").mkdir()

    def embed(rows):
        folder = str(tmp_path / "calls")

        def run(batches):
            for pdf in batches:
                for t in pdf["text"]:
                    (Path(folder) / hashlib.md5(f"{t}{time.monotonic_ns()}".encode()).hexdigest()).write_text(json.dumps([t]))
                yield pdf.assign(value=[None if t == "bad" else [float(len(t))] for t in pdf["text"]])

        return rows.mapInPandas(run, "text string, value array<double>")

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    ask = lambda df, m="m": {r.text: r.value for r in answers.remembered(df, embed, str(tmp_path / "s"), m).collect()}
    assert ask(texts("a", "bb", "a", "bad", None)) == {"a": [1.0], "bb": [2.0], "bad": None, None: None}
    assert calls(tmp_path / "calls") == {("a",): 1, ("bb",): 1, ("bad",): 1}
    assert ask(texts("a", "ccc")) == {"a": [1.0], "ccc": [3.0]}
    assert calls(tmp_path / "calls") == {("a",): 1, ("bb",): 1, ("bad",): 1, ("ccc",): 1}
    assert ask(texts("a"), "m2") == {"a": [1.0]} and calls(tmp_path / "calls")["a",] == 2


def fixed(answer):
    return lambda mode, system, user: json.dumps(answer(user)) if answer(user) is not None else "?"


def test_characteristics_names_and_skills(spark):
    scores = lambda u: {"characteristics": [{"characteristic_id": "lab", "confidence": 0.1}, {"characteristic_id": "lab", "confidence": 1.7}, {"characteristic_id": "x", "confidence": 1}, {"characteristic_id": "math", "confidence": -2}]} if u == "good" else None
    texts = spark.createDataFrame([("v1", "good"), ("v2", "bad")], "vacancy_id string, text string")
    by_model = lambda df: answers.scored_characteristics(df, {"lab": "works in a laboratory", "math": "models"}, answers.decoder(fixed(scores), "m"))
    assert {r.vacancy_id: r.scores for r in by_model(texts).collect()} == {"v1": {"lab": 1.0, "math": 0.0}, "v2": None}
    second = lambda df: df.select("vacancy_id", F.create_map(F.lit("math"), F.lit(0.5)).alias("scores"))
    both = characteristics.scored_or(texts, by_model, second)
    assert {(r.vacancy_id, r.characteristic, r.confidence) for r in both.collect()} == {("v1", "lab", 1.0), ("v2", "math", 0.5)}
    roles = spark.createDataFrame([("physicist", ["physicist", "researcher"], 3), ("chemist", ["chemist"], 2)], "role string, top_titles array<string>, member_count int")
    named = answers.named_roles(roles, answers.decoder(fixed(lambda u: {"name": "  Physics "} if "researcher" in u else {"name": " "}), "m"))
    assert {r.role: r.label for r in named.collect()} == {"physicist": "Physics", "chemist": "chemist"}
    rows = spark.createDataFrame([("v1", "good"), ("v2", "bad")], "vacancy_id string, description string")
    found = answers.skill_phrases(rows, answers.decoder(fixed(lambda u: {"skills": [" SQL", "sql", "", None, "R"]} if u == "good" else None), "m"))
    assert [(r.vacancy_id, r["at"], r.text, r.lemma) for r in found.orderBy("at").collect()] == [("v1", 0, "sql", "sql"), ("v1", 1, "r", "r")]
