"""Operators of quillspark.llm on small cases, without Spark where they allow it."""

import hashlib
import random
import struct
import time

import numpy as np
import pytest

from quillspark.llm import byte_cnn, gif, html_blocks, langid, lz_fingerprint, minhash, packing, words


def test_words_and_shingles():
    block = [words.normalised(t) for t in ("A b\tc  D e f", "", None, "x y", "x y")]
    sets = words.shingle_sets(block)
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1]
    assert (sets[3] == sets[4]).all()
    lower = words.shingle_sets([words.normalised("a b c d e f")])[0]
    assert (lower == sets[0]).all()


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (900, 100, 100))
    sets = [np.unique(np.concatenate([common, x])) for x in (a, b)]
    s = minhash.signatures(sets)
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.1
    # parts of the members give the same signature as the whole
    assert (minhash.signatures(sets, step=64) == s).all()


@pytest.mark.parametrize("n", [0, 1, 2, 575, 576, 5000, 60000])
def test_lzw_round_trip(n):
    random.seed(n)
    for alphabet in (b"ab", bytes(range(256))):
        data = bytes(random.choice(alphabet) for _ in range(n))
        assert gif.lzw_decode(gif.lzw_encode([b"x", data])[1], 8, n) == data


@pytest.mark.parametrize("depth", [2, 4, 8])
def test_lzw_streams_do_not_depend_on_company(depth):
    """Parts encoded abreast give the streams that they give alone, up to the length that fills a table and beyond it."""
    rng = np.random.default_rng(depth)
    longest = 4094 - (1 << depth)
    lengths = [0, 1, 2, 575, 576, longest - 1, longest, longest + 1, longest + 2, 9000, *rng.integers(1, 3000, 80)]
    parts = [rng.integers(0, alphabet, n).astype(np.uint8).tobytes() for n in lengths for alphabet in (1, 3, 1 << depth)]
    streams = gif.lzw_encode(parts, depth)
    assert streams == [gif.lzw_encode([p], depth)[0] for p in parts]
    assert [gif.lzw_decode(s, depth, len(p)) for s, p in zip(streams, parts)] == parts


def test_frames_abreast_take_less_time():
    """CPU time of many frames together against one by one; together they once took as long."""
    rng = np.random.default_rng(6)
    vocabulary = ["".join(rng.choice(list("etaoinshrdlu"), n)) for n in rng.integers(2, 9, 500)]
    text = " ".join(rng.choice(vocabulary, 900000)).encode()
    parts = [text[i : i + 2304] for i in range(0, 2048 * 2304, 2304)]

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    alone = min(seconds(lambda: [gif.lzw_encode([p]) for p in parts]) for _ in range(2))
    assert min(seconds(lambda: gif.lzw_encode(parts)) for _ in range(2)) < 0.8 * alone


@pytest.mark.parametrize("again", [False, True])
def test_lzw_deferred_clear(again):
    """A table that stays full for more than 4,400 codes, and one that is cleared after that."""
    random.seed(8)

    def stream(parts):
        bits, at = 0, 0
        for k, data in enumerate(parts):
            table, free, width = {bytes([i]): i for i in range(256)}, 258, 9
            codes, w = [], b""
            bits, at = bits | 256 << at, at + (9 if k == 0 else 12)
            for x in data:
                if w + bytes([x]) in table:
                    w += bytes([x])
                    continue
                bits, at = bits | table[w] << at, at + width
                if free < 4096:
                    table[w + bytes([x])] = free
                    free += 1
                    width = max(width, (free - 1).bit_length())
                w = bytes([x])
            bits, at = bits | table[w] << at, at + width
        return (bits | 257 << at).to_bytes(at // 8 + 4, "little")

    parts = [bytes(random.choice(b"abcdefgh") for _ in range(60000)) for _ in range(1 + again)]
    data = b"".join(parts)
    assert gif.lzw_decode(stream(parts), 8, len(data)) == data


def _gif(frames, width=4, height=4):
    """Frames of (disposal, transparent index or None, x, y, w, h, samples, interlaced) with a palette of 4 colours."""
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x81, 0, 0), bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for disposal, clear, x, y, w, h, samples, interlaced in frames:
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, clear or 0, 0))
        data = gif.lzw_encode([bytes(samples)], 2)[0]
        out.append(struct.pack("<BHHHHBB", 0x2C, x, y, w, h, 0x40 if interlaced else 0, 2) + bytes([len(data)]) + data + b"\x00")
    return b"".join([*out, b"\x3b"])


def test_disposal_and_transparency():
    full = [1] * 16
    data = _gif(
        [
            (1, None, 0, 0, 4, 4, full, False),
            (2, 0, 1, 1, 2, 2, [2, 0, 0, 2], False),
            (3, None, 0, 0, 1, 1, [3], False),
            (1, None, 3, 3, 1, 1, [2], False),
        ]
    )
    shown = list(gif.decode(data))
    assert [f.delay_ms for f in shown] == [50] * 4
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    at = lambda f, y, x: tuple(int(v) for v in f.pixels[y, x, :3])
    assert at(shown[0], 0, 0) == red and at(shown[1], 1, 1) == green and at(shown[1], 1, 2) == red
    assert shown[2].pixels[1, 1, 3] == 0 and at(shown[2], 0, 0) == blue
    assert at(shown[3], 0, 0) == red and at(shown[3], 3, 3) == green
    assert gif.histogram(shown[0].pixels)[7] == 16


def test_interlaced_rows():
    samples = [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4
    frame = next(gif.decode(_gif([(1, None, 0, 0, 4, 4, samples, True)])))
    # rows come as 0, then none of 4 and 8, then 2, then 1 and 3
    assert [int(frame.pixels[y, 0, :3].argmax()) if frame.pixels[y, 0, :3].any() else -1 for y in range(4)] == [-1, 1, 0, 2]


def test_gif_payload():
    payload = "Ünïcode text ".encode() * 300
    payload = payload.ljust(-(-len(payload) // gif.UNIT) * gif.UNIT, b"\xff")
    back = b"".join(f.drawn()[..., 0].tobytes() for f in gif.decode(gif.encode(payload)))
    assert hashlib.sha256(back).digest() == hashlib.sha256(payload).digest()


def test_phrases_are_lz78():
    def plain(text):
        seen, out, w = set(), [], ""
        for i, c in enumerate(text):
            w += c
            if w not in seen:
                seen.add(w)
                out.append(i + 1)
                w = ""
        return out + ([len(text)] if w else [])

    random.seed(3)
    for n in (0, 1, 7, 300, 3000):
        text = "".join(random.choice("abé ") for _ in range(n))
        assert lz_fingerprint.phrases(text) == plain(text)
    text = "abababab" * 50
    ends = []
    seen, n = lz_fingerprint.parse(text, set(), ends, 200)
    assert n == sum(e <= 200 for e in ends) and seen == {text[i:j] for i, j in zip([0, *ends], ends[:n])}
    again = ends[:n]
    lz_fingerprint.parse(text, seen, again)
    assert again == ends


def test_edited_fingerprints_match_whole_parses():
    docs = [(1, "one text and one more " * 20), (2, "zwei Texte"), (3, ""), (4, "one text and one more " * 20)]
    rows = lz_fingerprint._compared(docs)
    for (_, a), (_, b), row in zip(docs, docs[1:], rows):
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        assert row[3] == lz_fingerprint.text_fingerprint(a) and row[4] == lz_fingerprint.text_fingerprint(edited)
        assert row[2] == hashlib.sha256(edited.encode()).hexdigest()
    assert lz_fingerprint.text_fingerprint(docs[0][1]) == lz_fingerprint.text_fingerprint(docs[3][1])
    assert lz_fingerprint.text_fingerprint(None) == lz_fingerprint.text_fingerprint("")


PAGE = """<html><head><title>x</title><script>var a="</p>";</script></head><body class="has-sidebar"><header><a href="/">Site</a><p>Tag line</p></header>
<div id="cookie-banner">We use cookies on this site to make it better for all of you</div><div class="breadcrumbs"><a href=1>Home</a> &gt; <a href=2>News</a></div>
<main><article class=post><header><h1>Title &amp; co</h1></header><p>First  <b>para</b> with <a href=x>a link</a> in it.<br>More</p><p>No.</p><aside>Related stuff here</aside>
<div class="ad">buy now</div></article><section id="comments"><h3>Comments</h3><p>A reader says a very long thing about this article and so on and on</p>
<form><label>Your comment</label><textarea>zz</textarea></form></section></main><footer>Copyright</footer></body></html>"""


def test_main_text():
    tree = html_blocks.grow(html_blocks.LABELLED)
    assert html_blocks.main_text(PAGE, tree) == "Title & co First para with a link in it. More No."
    assert html_blocks.main_text(None, tree) == html_blocks.main_text("", tree) == ""
    assert html_blocks.main_text("<article><p>Cut off &amp; gone</p><p cla", tree) == "Cut off & gone"
    assert all(tree.says(x) == bool(y) for x, y in html_blocks.LABELLED)


def test_language_model():
    english, german = "the cat and the dog of the house", "der Hund und die Katze im Haus"
    model = langid.fit([(english, "en"), (german, "de")] * 3)
    assert model.predict("The dog and a cat")[0] == "en"
    assert model.predict("Hunde und Katzen")[0] == "de"
    assert model.predict("katzenhaus")[0] == "de"  # no known word
    for empty in (None, "", "123 !?", "½ ²"):
        assert model.predict(empty) == ("und", 0.0)
    assert langid.fit([]).predict("words") == ("und", 0.0)


def test_network_separates_and_is_local():
    good = [f"Plain words in a row number {i} and some more of them here." * (1 + i % 5) for i in range(150)]
    bad = [f"WORDS!! IN!! CAPITALS!! {i}!! AND!! MORE!! OF!! THEM!!" * (1 + i % 5) for i in range(150)]
    net = byte_cnn.fit(good + bad, [1] * 150 + [0] * 150)
    s = net.scores(good[:20] + bad[:20])
    assert (s[:20] > 0.5).all() and (s[20:] < 0.5).all()
    # a score depends on its own text alone
    assert np.allclose([net.scores([t])[0] for t in bad[:3] + [None, ""]], net.scores(bad[:3] + [None, ""]))
    assert byte_cnn.fit([], []).scores(["x"])[0] == 0.5


def test_packing_limits():
    packer = packing.Packer((100, 4, 30), cut=False, window=8)
    random.seed(5)
    examples = [(i, random.randint(1, 90), 0) for i in range(300)]
    examples = [(i, t, min(t // 3, 30)) for i, t, _ in examples]
    out = [s for e in examples for s in packer.add(*e)] + list(packer.end())
    loss = {i: x for i, _, x in examples}
    assert sorted(p[0] for s in out for p in s) == list(range(300))
    for s in out:
        assert sum(p[2] for p in s) <= 100 and len(s) <= 4 and sum(loss[p[0]] for p in s) <= 30 + 1e-6
    with pytest.raises(ValueError):
        list(packing.Packer((100, 4, 30), cut=False).add(1, 101, 0))


def test_packing_cuts_without_padding():
    packer = packing.Packer((1024, 128, 1024), cut=True)
    sizes = [1, 5000, 1024, 3, 700, 1023, 2048] * 30
    out = [s for i, n in enumerate(sizes) for s in packer.add(i, n, n)] + list(packer.end())
    for s in out:
        total = sum(p[2] for p in s)
        assert total <= 1024 and len(s) <= 128
    padding = sum(1024 - t for s in out if (t := sum(p[2] for p in s)) & (t - 1))
    assert padding == 0
    got = {}
    for s in out:
        for i, start, n in s:
            got.setdefault(i, []).append((start, n))
    for i, n in enumerate(sizes):
        at = 0
        for start, k in sorted(got[i]):
            assert start == at
            at += k
        assert at == n


def test_token_ids_are_those_of_the_tokenizer():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t, ids = Tokenizer.from_file(path), packing.Ids(path)
    assert ids._ranked
    random.seed(2)
    texts = ["a  b", " x", "x ", "a\n b", "it's  'll x", "<|endoftext|> a", "é  b c", "a\u00a0 b", "a\x00b c", "日本 語 12,3 a's", "plain words, here.\nAnd more"]
    texts += ["x" * 3000, " " * 3000, "\n" * 5000 + "a", "!?" * 4000, "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(3000)), "", None]
    texts += ["".join(random.choices("ab cde' stl\n\t1é,.İ", k=200)) for _ in range(300)]
    texts += ["".join(chr(random.choice((random.randint(1, 0x2FF), random.randint(0x1F300, 0x1F6FF), 32))) for _ in range(80)) for _ in range(200)]
    for text in texts:
        assert t.encode(text or "", add_special_tokens=False).ids == list(np.frombuffer(ids.of(text), "<u4")), text


def test_other_tokenizer_files():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    ids = packing.Ids(path)
    assert not ids._ranked
    assert list(np.frombuffer(ids.of("Some words, here"), "<u4")) == Tokenizer.from_file(path).encode("Some words, here", add_special_tokens=False).ids
