"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from quillspark.llm import errata_trie, queries
from tests.oracle import compared


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_pairs_of_a_trie(seed):
    random.seed(seed)
    words = sorted({"".join(random.choice("ab" if seed % 2 else "abcé") for _ in range(random.randint(0, 6))) for _ in range(120)})
    for reach in (0, 2, 99):
        got = Counter(frozenset(p) for p in errata_trie.near_pairs(words, reach))
        want = {frozenset((i, j)) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if one_edit(a, b) and common(a, b) <= reach}
        assert set(got) == want and set(got.values()) <= {1}


def brute(rows, least=6, often=5, ratio=5, slips=199):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % slips == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= often}
    near = {w: sorted((x for x in n if x != w and one_edit(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: x[0] if x and n[x[0]] >= ratio * n[w] else None for w, x in near.items()}
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: tuple(r)[1:] for r in rows}


@pytest.fixture(scope="module")
def corpus():
    random.seed(5)
    rows = []
    bases = ["".join(random.choice("abcdeàÿ") for _ in range(random.randint(5, 11))) for _ in range(25)] + ["aaaaaaaa", "aaaaaaab", "abababab"]
    for i in range(160):
        words = []
        for _ in range(60):
            w = random.choice(bases)
            if random.random() < 0.35:
                at = random.randrange(len(w) + 1)
                w = random.choice((w[:at] + random.choice("abÉ") + w[at:], w[: max(at - 1, 0)] + w[at:], w[:at] + random.choice("abcA") + w[at + 1 :]))
            words.append(w)
        rows.append((i, random.choice((" ", "-", "1", "ß ")).join(words)))
    return rows + [(None, "Couleur " * 7), (3, rows[3][1]), (500, ""), (501, None), (502, "colour " * 40 + "colours " * 6 + "colourss " * 30)]


@pytest.mark.parametrize(("group", "slips"), [(20_000, 199), (3, 7)])
def test_variants(spark, corpus, group, slips):
    docs = spark.createDataFrame(corpus, "doc_id long, text string").repartition(5)
    assert found(errata_trie.variants(docs, group=group, slips=slips)) == brute(corpus, slips=slips)


def test_groups_are_halved_until_they_are_small(spark):
    # a third of all words share all but three letters, so both their halves
    random.seed(1)
    hot = ["q" * 30 + "".join(random.choice("abcdefg") for _ in range(3)) + "q" * 20 for _ in range(200)]
    rest = ["".join(random.choice("abcdefghijkl") for _ in range(12)) for _ in range(300)]
    rows = [(i, f"{w} " * 5) for i, w in enumerate(hot + rest)]
    words = errata_trie.vocabulary(spark.createDataFrame(rows, "doc_id long, text string"), slips=0)
    sizes = errata_trie._keyed(errata_trie.grouped(words, group=25)).groupBy("m", "low", "high", "front", "back").count()
    assert sizes.agg({"count": "max"}).first()[0] <= 49  # one place: 7 and at most 7 * 7 words
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(errata_trie.variants(docs, group=25)) == brute(rows)


def test_odd_tables(spark):
    long = "verylongword " * 120_000
    rows = [(1, long, "x", 1), (2, None, None, 2), (None, None, "y", None), (4, "  12 _ ", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n long")
    assert set(found(errata_trie.variants(docs))) == {"verylongword"} or zlib.crc32(b"1:verylongword") % 199 == 0
    assert errata_trie.variants(docs.limit(0)).count() == 0
    assert errata_trie.variants(docs.where("doc_id = 4")).count() == 0


def test_slices_keep_runs_whole():
    text = ("é" * 7 + " ") * 400_000 + "z" * (errata_trie.SLICE + 5)
    parts = list(errata_trie._slices(text))
    assert "".join(parts) == text and len(parts) > 2
    assert sum(len(re.findall("[a-zé]+", p)) for p in parts) == 400_001


def test_ties_and_ways(spark):
    # two near words of equal count: the first by code point; forms of forms lead to one root
    text = "abcdef " * 5 + "abcdeg " * 30 + "abcdeh " * 30 + "abcdeghi " * 160 + "abcdeghij " * 900
    got = found(errata_trie.variants(spark.createDataFrame([(1, text)], "doc_id long, text string"), slips=0))
    assert got["abcdef"] == ("abcdeg", "abcdeg", 5, 2, 30)
    assert got["abcdeghi"] == ("abcdeghij", "abcdeghij", 160, 1, 900)
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)], "word string, form string")
    assert {r.root for r in errata_trie.roots(forms).collect()} == {"w9"}


def test_query(spark):
    assert compared(spark, queries.op11_errata_trie, queries.OP11_SQL) > 0
