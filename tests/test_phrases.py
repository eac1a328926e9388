"""Noun phrases of literal and random trees, and canonical phrases."""

import random

from pyspark.sql import functions as F

from quillspark.operators import mapping, phrases

SCHEMA = f"doc string, sentence int, tokens {phrases.TOKENS}"


def tree(spec):
    """Tokens from lines `text lemma tag relation head`."""
    return [(t, lemma, tag, rel, int(head)) for t, lemma, tag, rel, head in (line.split() for line in spec.strip().splitlines())]


ANALYSIS = tree("""
Опыт опыт NOUN ROOT 0
количественного количественный ADJ amod 2
анализа анализ NOUN nmod 0
больших большой ADJ amod 4
данных данные NOUN nmod 2
""")
CONJUNCTS = tree("""
Знание знание NOUN ROOT 0
химии химия PROPN nmod 0
и и CCONJ cc 4
органической органический ADJ amod 4
физики физика NOUN conj 1
""")
PARTICIPLE = tree("""
сильно сильно ADV advmod 1
развитое развить VERB amod 2
мышление мышление NOUN nsubj 3
помогает помогать VERB ROOT 3
студентам студент NOUN obl 3
""")


def walked(tokens):
    """(noun, positions) by a walk downwards from each noun."""
    out, seen = [], set()
    for i, t in enumerate(tokens):
        if t[2] not in ("NOUN", "PROPN"):
            continue
        kept, stack, visited = {i}, [i], {i}
        while stack:
            h = stack.pop()
            for j, c in enumerate(tokens):
                if c[4] != h or j == h or j in visited or c[3] == "conj":
                    continue
                visited.add(j)
                participle = c[2] == "VERB" and c[3] == "amod"
                if c[2] in ("NOUN", "PROPN", "ADJ") or participle:
                    kept.add(j)
                if c[2] == "ADJ" or participle or (c[2] in ("NOUN", "PROPN") and c[3] == "nmod"):
                    stack.append(j)
        span = (min(kept), max(kept))
        if span not in seen:
            seen.add(span)
            out.append((i, tuple(sorted(kept))))
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(str(d), s, t) for d, s, t in rows], SCHEMA)
    return sorted((r.doc, r.sentence, r["at"], r.text, r.lemma) for r in phrases.noun_phrases(df, "doc", **options).collect())


def test_literal_trees(spark):
    got = found(spark, [(1, 0, ANALYSIS), (1, 1, CONJUNCTS), (2, 0, PARTICIPLE), (3, 0, []), (4, 0, None)])
    assert [(d, s, text) for d, s, _, text, _ in got] == [
        ("1", 0, "опыт количественного анализа больших данных"), ("1", 0, "количественного анализа больших данных"), ("1", 0, "больших данных"),
        ("1", 1, "знание химии"), ("1", 1, "химии"), ("1", 1, "органической физики"), ("2", 0, "развитое мышление"), ("2", 0, "студентам"),
    ]
    assert got[0][4] == "опыт количественный анализ большой данные"
    assert "знание химии" not in {r[3] for r in found(spark, [(1, 1, CONJUNCTS)], dropped=("знание химии",))}


def test_random_trees(spark):
    random.seed(6)
    rows = []
    for n in range(60):
        size = random.randint(1, 12)
        order = list(range(size))
        random.shuffle(order)
        head = {order[0]: order[0]} | {x: random.choice(order[:k]) for k, x in enumerate(order) if k}
        tags, relations = ("NOUN", "PROPN", "ADJ", "VERB", "ADP"), ("nmod", "amod", "conj", "obj")
        rows.append((n, 0, [(f"W{i}", f"l{i}", random.choice(tags), random.choice(relations), head[i]) for i in range(size)]))
    want = sorted(
        (str(n), 0, i, " ".join(t[j][0] for j in kept).lower(), " ".join(t[j][1] for j in kept)) for n, _, t in rows for i, kept in walked(t)
    )
    assert found(spark, rows) == want


def test_key_skills_follow_phrases(spark):
    own = spark.createDataFrame([("v", 0, "Анализ", "анализ"), ("v", 1, " анализ ", "анализ"), ("v", 2, "a b c d e f g h i", "x"), ("w", 0, "", "")], "k string, at int, text string, lemma string")
    given = spark.createDataFrame([("v", 0, "Python"), ("v", 1, "АНАЛИЗ"), ("u", 0, "sql")], "k string, at int, text string")
    got = sorted(tuple(r) for r in phrases.with_key_skills(own, given, "k").collect())
    assert got == [("u", 0, "sql", "sql"), ("v", 0, "анализ", "анализ"), ("v", 1, "python", "python")]


def test_canonical_terms(spark):
    rows = [(f"d{i}", 0, "data analysis", "data analysis") for i in range(6)] + [(f"d{i}", 1, "data analyses", "data analyses") for i in range(4)]
    rows += [(f"d{i}", 2, "chemistry", "chemistry") for i in range(3)] + [("d0", 3, "quux", "quux"), ("d9", 0, "data analyses", "data analyses")]
    df = spark.createDataFrame(rows, "k string, at int, text string, lemma string")
    embed = lambda t: t.withColumn("embedding", mapping.letters(F.col("title")))
    got = {(r.k, r.term): r.df for r in phrases.canonical_terms(df, "k", embed, 0.9, 2, 3).collect()}
    want = {(f"d{i}", "data analysis"): 7 for i in (*range(6), 9)} | {(f"d{i}", "chemistry"): 3 for i in range(3)}
    assert got == want
    capped = phrases.canonical_terms(df, "k", embed, 0.9, 1, 1)
    assert {(r.k, r.term) for r in capped.collect()} == {(f"d{i}", "data analysis") for i in (*range(6), 9)}
