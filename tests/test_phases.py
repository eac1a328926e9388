"""The phases end to end over a few generated postings."""

from pyspark.sql import functions as F

from quillspark import cli
from quillspark.config import Config
from quillspark.plans import phases

GLOSSARY = [("a1", "лаборатория"), ("a2", "анализ"), ("a3", "физика"), ("a1", "анализ")]


def test_tiers(spark):
    rows = [
        ("1", "Инженер", "исследования в лаборатории физики", [(96, "x")]),
        ("2", "Программист", "код и ещё код", []),
        ("3", "Программист", "исследования физики", []),
        ("4", None, None, None),
    ]
    df = spark.createDataFrame(rows, "id string, name string, description string, professional_roles array<struct<id:int,name:string>>")
    got = {r.vacancy_id: r.stem_category for r in phases.classified(df, Config()).collect()}
    assert got == {"1": "PURE_IT", "2": "PURE_IT", "3": "STEM_RESEARCH", "4": "NON_STEM"}


TITLES = [f"{kind} {level}" for kind in ("физик теоретик", "химик органик") for level in ("старший", "младший", "ведущий", "главный", "стажёр", "эксперт")]


def postings(spark, n=48):
    rows = [
        (str(i), TITLES[i % 12], f"исследования: лаборатория, анализ и физика, лабораторией номер {'abc'[i % 3]} research", [], [("Спектроскопия",)] if i % 2 else [])
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "id string, name string, description string, professional_roles array<struct<id:int,name:string>>, key_skills array<struct<name:string>>")


def test_roles_by_density(spark):
    conf = Config(min_cluster_size=4, cluster_epsilon=0.0)
    rows = phases.classified(postings(spark), conf)
    odd = rows.limit(1).withColumn("title", F.lit("zzz qqq"))
    named, found = phases.roles(rows.unionByName(odd), conf)
    role = {r.title: r.role for r in named.collect()}
    assert len(role) == 13 and len({role[t] for t in TITLES[:6]}) == 1 and len({role[t] for t in TITLES[6:]}) == 1 and role[TITLES[0]] != role[TITLES[6]]
    table = {r.role: r for r in found.collect()}
    assert sorted((r.member_count, r.noise_flag) for r in table.values()) == [(1, True), (6, False), (6, False)]
    assert all(r.top_titles[0] == k and len(r.top_titles) == (1 if r.noise_flag else 3) for k, r in table.items())
    alone, only_noise = phases.roles(odd, conf)
    assert alone.count() == 0 and [r.noise_flag for r in only_noise.collect()] == [True]


def test_skills_are_canonical(spark):
    conf = Config(min_document_frequency=2, dedup_similarity=0.6)
    rows = phases.classified(postings(spark), conf)
    got = {r.skill_phrase for r in phases.skills(rows, conf).select("skill_phrase").distinct().collect()}
    assert "спектроскопия" in got and "физика" in got  # key skills come after words
    assert len(got & {"лаборатория", "лабораторией"}) == 1
    extractor = lambda df: df.select("vacancy_id", F.lit(0).alias("at"), F.lit("опыт работы").alias("text"), F.lit("опыт работы").alias("lemma"))
    only = phases.skills(rows, conf, phases.Scorers(phases.keyword_scores, phases.hashed_embedding, phrases=extractor))
    assert {r.skill_phrase for r in only.collect()} == {"спектроскопия"}
    cut = lambda df: df.select("vacancy_id", F.lit(0).alias("pos"), F.lit("только анализ здесь").alias("sentence"), F.lit("requirements").alias("label"))
    some = phases.skills(rows, conf, phases.Scorers(phases.keyword_scores, phases.hashed_embedding, sections=cut))
    assert {r.skill_phrase for r in some.collect()} == {"только", "анализ", "здесь", "спектроскопия"}


def test_axes_by_cosine_alone(spark):
    own = spark.createDataFrame([("r1", "лабораторный"), ("r2", "физика"), ("r2", "анализ"), ("r3", "zzz")], "role string, skill string")
    glossary = spark.createDataFrame(GLOSSARY, "axis string, skill string")
    got = {(r.role, r.axis): (r.proficiency, [c.skill for c in r.contributing]) for r in phases.axis_scores(own, glossary).collect()}
    assert len(got) == 9 and got["r1", "a1"][0] > got["r3", "a1"][0]  # no glossary has the skill, its cosine counts
    assert got["r2", "a3"][0] == 5.0 and got["r2", "a3"][1][0] == "физика"
    given = lambda rest: rest.select("skill", F.lit("a2").alias("axis"))
    more = phases.axis_scores(own, glossary, phases.Scorers(phases.keyword_scores, phases.hashed_embedding, axes=given))
    assert {r.role: r.proficiency for r in more.where("axis = 'a2'").collect()}["r3"] > got["r3", "a2"][0]


def test_all(spark, tmp_path, capsys):
    postings(spark).write.parquet(str(tmp_path / "r"))
    spark.createDataFrame(GLOSSARY, "axis string, skill string").write.parquet(str(tmp_path / "g"))
    (tmp_path / "c.yaml").write_text(f"warehouse: {tmp_path}/w\nmin_document_frequency: 2\nmin_cluster_size: 4\ncluster_epsilon: 0.0\n")
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "--domain", "d", "all", str(tmp_path / "r"), str(tmp_path / "g")]) == 0
    assert "- vacancies: 48" in capsys.readouterr().out
    scores = spark.read.parquet(f"{tmp_path}/w/characteristic_scores")
    assert scores.where((F.col("proficiency") < 1) | (F.col("proficiency") > 5)).isEmpty() and scores.count() == 6
    assert scores.where(F.size("contributing") > 3).isEmpty()
    model = spark.read.json(f"{tmp_path}/w/models").first()
    assert len(model.characteristics) == 3 and len(model.competency_levels) == 7 and model.member_count == 6
