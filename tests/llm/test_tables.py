"""Operators of quillspark.llm over small tables, against brute force."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.llm import backoff_lm, hash_tree, html_blocks, lz_fingerprint, minhash, mixing, packing, queries
from tests.oracle import DATA, compared

LONG = "word " * 30000
TEXTS = [
    "one two three four five six seven eight nine ten eleven twelve",
    "one two three four five six seven eight nine ten eleven twelve",
    "One two three four five six seven eight nine ten eleven twelve extra",
    "short text",
    "Short text",
    "",
    None,
    LONG,
    "completely different words are found in this one here and there too",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, "s1" if i % 3 else None, 5, "x") for i, t in enumerate(TEXTS)]
    rows.append((None, "no id at all", None, "s2", None, None))
    rows.append((0, TEXTS[0], "en", None, 5, "again"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, bucket string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def brute_components(texts):
    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in texts.items()}
    own = {i: i for i in texts}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
                lo, hi = sorted((root(a), root(b)))
                own[hi] = lo
    return {i: root(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates(docs, empty):
    got = minhash.classes(docs).collect()
    want, sizes = brute_components(dict(enumerate(TEXTS)))
    for r in got:
        if r.doc_id is not None:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], sizes[r.doc_id], want[r.doc_id] == r.doc_id)
    assert len(got) == docs.count()
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, c in want.items() if i == c} | {None}
    assert minhash.classes(empty).count() == 0 and minhash.keep_one(empty).count() == 0


def test_copies_go_by_row_not_by_id(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (None, a), (None, b), (None, c + " more"), (3, c), (4, d), (4, a), (5, "words of two"), (5, d + " more"), (6, "")]
    kept = minhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [(1, a), (None, b), (3, c), (4, d), (5, "words of two"), (6, "")]
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(want)


def test_large_group_of_near_copies(spark):
    import random

    random.seed(11)
    base = [f"w{random.randint(0, 400)}" for _ in range(120)]
    texts = {}
    for i in range(90):
        words = list(base)
        for _ in range(random.randint(0, 14)):
            words[random.randrange(120)] = f"x{random.randint(0, 9999)}"
        texts[i] = " ".join(words)
    got = minhash.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want, _ = brute_components(texts)
    assert {r.doc_id: r.component_id for r in got} == want


def test_minhash_query(spark):
    compared(spark, queries.op3_minhash, queries.OP3_SQL)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_sharding(docs, empty):
    got = hash_tree.place(docs, hash_tree.tree(16)).collect()
    assert len(got) == docs.count()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got:
        if r.doc_id is not None:
            data = (TEXTS[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(data) + 1, zlib.crc32(data))
    assert hash_tree.place(empty, hash_tree.tree(16)).count() == 0


def test_sharding_follows_weights(spark):
    ids = spark.range(20000)
    shape = [[[1.0, 3.0], [2.0]], [[2.0]]]
    n = Counter(r.s for r in ids.select(hash_tree.shard_of(F.col("id"), shape).alias("s")).collect())
    for shard, share in enumerate((1 / 8, 3 / 8, 2 / 8, 2 / 8)):
        assert abs(n[shard] / 20000 - share) < 0.02
    moved = ids.select(hash_tree.shard_of(F.col("id"), shape).alias("a"), hash_tree.shard_of(F.col("id"), [[[1.0, 5.0], [2.0]], [[2.0]]]).alias("b")).where("a <> b")
    assert {r.b for r in moved.collect()} <= {0, 1, 2}  # within the region whose weight grew


def water_filling(sizes, weights, share=1.5, most=2.0):
    left, free, target = share * sum(sizes.values()), set(sizes), {}
    while True:
        level = left / sum(weights[s] for s in free) if free else 0
        over = {s for s in free if level * weights[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over


def test_mixing(spark, docs, empty):
    got = mixing.mix(docs, None).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    rows = [(i, "w " * (1 + i * 7 % 40), f"s{i % 7}" if i % 7 else None) for i in range(400)] + [(900 + i, "w " * 900, "big") for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 400, 3)] + [(5, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in mixing.mix(table, labels).collect()}
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
        taken[s] += got[i].taken
    order = sorted(x for x in sizes if x is not None) + [None]
    want = water_filling(dict(sizes), {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)})
    for i, _, s in rows:
        assert math.isclose(got[i].target, want[s], rel_tol=1e-9) and got[i].source_size == sizes[s]
    for s in sizes:
        assert taken[s] == math.floor(want[s] + 1e-9)
    again = {r.doc_id: r.taken for r in mixing.mix(table.repartition(5), labels).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix(empty, None).count() == 0
    back = Counter(r.doc_id for r in mixing.selected(table, labels).collect())
    assert all(back[i] == math.ceil(r.taken / r.size) for i, r in got.items())


def test_backoff_scores(spark, docs, empty):
    held = F.col("doc_id") % 4 == 3
    got = {r.doc_id: r for r in backoff_lm.scored(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), ~held).collect()}
    tokens = {i: (t or "").lower().split() + [None] for i, t in enumerate(TEXTS)}
    counts = Counter(w for i, t in tokens.items() if i % 4 != 3 for w in t)
    n, v = sum(counts.values()), len(counts)
    for i, t in tokens.items():
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert math.isclose(got[i].base_score, base, rel_tol=1e-9)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(counts[w] > 0 for w in t), n)
    assert backoff_lm.scored(empty, F.lit(True)).count() == 0
    assert backoff_lm.scored(docs, F.lit(False)).first().train_tokens == 0


def test_every_ngram_is_scored_from_its_counts(spark, monkeypatch):
    import random

    random.seed(7)
    monkeypatch.setattr(backoff_lm, "BLOCK", 40_000)
    # pairs of tokens that are all too rare for any rank: only their own counts predict the second from the first
    texts = {i: " ".join(f"a{k} b{k}" for k in random.choices(range(6000), k=150)) for i in range(200)}
    texts |= {200: "a1 b1 a1 b1 a1 b2", 201: "", 202: None, 203: "a1"}
    learned = {i: ["<s>", *(t or "").split(), "</s>"] for i, t in texts.items() if i % 5 != 1}
    uni, grams, total = Counter(), Counter(), Counter()
    for t in learned.values():
        uni.update(t[1:])
        for i in range(1, len(t)):
            grams.update(tuple(t[j : i + 1]) for j in (i - 1, i - 2) if j >= 0)
    for g, c in grams.items():
        total[g[:-1]] += c
    n, v = sum(uni.values()), len(uni)

    def p(h, w):
        if not h:
            return (uni[w] + 0.5) / (n + 0.5 * (v + 1))
        prior = backoff_lm.PRIOR[len(h) - 1]
        return (grams[*h, w] + prior * p(h[1:], w)) / (total[h] + prior)

    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in backoff_lm.scored(table, F.col("doc_id") % 5 != 1).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        t = ["<s>", *(t or "").split(), "</s>"]
        want = sum(math.log10(p(tuple(t[max(k - 2, 0) : k]), t[k])) for k in range(1, len(t)))
        assert math.isclose(got[i].score, want, rel_tol=1e-9), i
    vocabulary = {w for t in learned.values() for w in t[1:]}
    for h in (("<s>",), ("a1",), ("a1", "b1")):
        assert math.isclose(sum(p(h, w) for w in vocabulary) + p(h, "never"), 1.0)


def test_next_document_order(docs, empty):
    got = {r.doc_id: r for r in lz_fingerprint.with_next(docs.dropDuplicates(["doc_id"])).collect()}
    assert len(got) == len(TEXTS) + 1
    order = [None, *range(len(TEXTS))]
    text = lambda i: "no id at all" if i is None else TEXTS[i] or ""
    import hashlib

    for a, b in zip(order, order[1:] + order[:1]):
        half = len(text(a)) // 2
        edited = text(a)[: len(text(a)) - half] + text(b)[:half]
        assert got[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[a].n_chars == len(text(a))
    assert got[0].fingerprint == got[1].fingerprint and got[0].near_next == 1.0
    assert lz_fingerprint.with_next(empty).count() == 0


def test_pages(spark):
    rows = [(1, "u", "<article><p>Some text</p></article>", 0), (2, None, None, 1), (None, "v", "", 2)]
    got = html_blocks.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), ("", 0), ("Some text", 9)]


def test_packed_documents(docs, empty):
    rows = packing.pack_documents(docs).collect()
    total = {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert {r.doc_id for r in rows} == {*range(len(TEXTS)), None} and total[5] == total[6] == 1
    assert packing.pack_documents(empty).count() == 0


@pytest.mark.parametrize("name", ["op4_language", "op6_gif", "op10_quality"])
def test_query_rows(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = queries.queries()[name](spark, DATA)
    assert got.select("doc_id").exceptAll(docs.select("doc_id")).isEmpty() and got.count() == docs.count()


def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_ids_of_all_pieces(spark):
    """Every piece's checksum against the tokenizers library, and the layout of sequences."""
    P = pytest.importorskip("public_tokenizers")
    import numpy as np
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in documents(spark).collect()}
    seen, sequences = {}, {}
    for r in queries.op9_packing(spark, DATA).collect():
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(seen) == set(ids)
    for pieces, whole in [(p, len(ids[i])) for i, p in seen.items()] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == whole if whole else at <= 1024


def test_three_limits_bind(spark):
    rows = [(i, "some words of a text " * (1 + i * 7 % 40), 0.25 * (i % 5)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bearing double")
    pieces = packing.pack_documents(docs, tokens=256, segments=4, loss=100, share=F.col("bearing")).collect()
    share, sequences, total = {i: s for i, _, s in rows}, {}, Counter()
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append(r)
        total[r.doc_id] += r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in pieces)
    full = [0, 0, 0]
    for own in sequences.values():
        loss = sum(r.length * int(r.doc_tokens * share[r.doc_id]) / r.doc_tokens for r in own)
        assert sum(r.length for r in own) <= 256 and len(own) <= 4 and loss <= 100 + 1e-6
        full = [f + x for f, x in zip(full, (sum(r.length for r in own) == 256, len(own) == 4, loss > 95))]
    assert all(full)


def test_gif_digests(spark):
    import hashlib

    got = {r.doc_id: r for r in queries.op6_gif(spark, DATA).collect()}
    media = {}
    for r in documents(spark).collect():
        raw = (r.text or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 576)) * 576, b"\xff")
        d = got[r.doc_id]
        assert (d.n_bytes, d.payload_bytes, d.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert d.tail_crc32 == zlib.crc32(payload[-32:]) and media.setdefault(r.text, (d.media_bytes, d.media_sha256, d.feature)) == (d.media_bytes, d.media_sha256, d.feature)


def test_gifs_do_not_depend_on_what_is_stored_together(spark):
    from quillspark.llm import gif

    rows = [(i, t) for i, t in enumerate(["", None, "a" * 3000, "b", "", "some words " * 900, "b", None])] + [(None, "some words " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    want = Counter((i, len(t or ""), gif.encode((t or "").encode().ljust(max(1, -(-len(t or "") // 576)) * 576, b"\xff"))) for i, t in rows)
    for together in (1, 3000, gif.TOGETHER):
        assert Counter((r.doc_id, r.n_bytes, bytes(r.gif)) for r in gif.stored(docs, together=together).collect()) == want


def test_languages_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in documents(spark).collect()}
    rows = queries.op4_language(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out and lang[r.doc_id] and r.lang_pred != "und"]
    assert len(judged) > 30 and sum(judged) >= 0.97 * len(judged)


def test_quality_of_held_out_documents(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    rows = queries.op10_quality(spark, DATA).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    good = [r.predicted for r in rows if r.held_out and quality.get(r.doc_id) == 1]
    assert good and sum(good) >= 0.95 * len(good)


CLASHING = ("__size", "__times", "__n", "__gone0", "__hash0", "node", "size", "row", "times", "id", "from", "share", "block", "learn", "target", "key", "part", "copies")


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])


def test_stages_on_odd_tables(spark, docs, empty, clashing, monkeypatch):
    """Nulls, repeated rows, ties, long texts, no rows, and columns named as the operators might name theirs."""
    import corpus_pipeline as p

    monkeypatch.setattr("quillspark.llm.byte_cnn.STEPS", 50)
    for table in (clashing, clashing.limit(0)):
        n = table.count()
        for name, stage in p.STAGES[:-1]:
            out = stage(spark, table, DATA)
            assert out.columns == table.columns, name
            rows = out.collect()
            assert len(rows) <= 2 * n and all(r[c] == f"x{i}" for r in rows for i, c in enumerate(CLASHING)), name
        packed = p.pack_sequences(spark, table, DATA)
        assert packed.groupBy("doc_id").count().count() == table.select("doc_id").distinct().count()


def test_operators_on_odd_tables(spark, docs, clashing):
    from quillspark.llm import byte_cnn, gif, langid

    model, network = langid.fit([("the words of one", "en"), ("les mots du texte", "fr")] * 2), byte_cnn.fit([], [])
    runs = {
        "fingerprint": lz_fingerprint.with_next, "classes": minhash.classes, "place": lambda d: hash_tree.place(d, hash_tree.tree(16)),
        "mix": lambda d: mixing.mix(d, None), "language": lambda d: langid.predicted(d, model), "quality": lambda d: byte_cnn.scored(d, network),
        "gif": lambda d: gif.digests(gif.stored(d)), "lm": lambda d: backoff_lm.scored(d, F.lit(True)),
    }
    want = Counter(r.doc_id for r in docs.collect())
    for name, run in runs.items():
        assert Counter(r.doc_id for r in run(clashing).select("doc_id").collect()) == want, name
        assert run(clashing.limit(0)).count() == 0, name
    pages = clashing.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *CLASHING)
    assert html_blocks.extracted(pages).count() == docs.count() and html_blocks.extracted(pages.limit(0)).count() == 0
    same = {}
    for r in langid.predicted(docs, model).collect():
        same.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert all(len(x) == 1 for x in same.values())  # repeated rows score the same
    assert langid.fit([("w", "b"), ("w", "a")]).predict("w")[0] == "a"  # ties go to the first language


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    good = p.keep_quality(spark, docs, DATA)
    assert good.columns == docs.columns
    left = {r.doc_id for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in left for i in clean) >= 0.97 * len(clean)
    spoken = p.keep_languages(spark, good, DATA)
    assert spoken.count() >= 0.99 * good.count()
    one = p.near_dedup(spark, spoken, DATA)
    want, _ = brute_components({r.doc_id: r.text for r in spoken.collect()})
    assert {r.doc_id for r in one.select("doc_id").collect()} == {i for i, c in want.items() if i == c}
    mixed = p.mix_sources(spark, one, DATA)
    assert mixed.columns == docs.columns
    assert p.pack_sequences(spark, mixed, DATA).count() >= mixed.count()
