"""Operators that work text by text, against brute force and the libraries themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, pre_tokenizers

from pulsegrid.llm import html, licenses, media, packing, pii, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [" ", "  ", "▁", "\n", "\t", "a", "the", "é", "漢", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "　", "\x00", "\x1c", "12", "loser.", "“", "<|endoftext|>", "'s", "'", "\xa0", "²"]
DOCS = "doc_id long, text string, n_tokens string, spans int, lang string"
ROWS = [(1, "Hello  world", "x", 1, None), (1, "Hello  world", "x", 1, None), (2, None, None, None, "en"), (None, "a b", None, None, None), (3, "", "", 0, ""), (4, "word " * 30000, "", 0, "")]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


# ---- token counts ----


def test_the_vocabulary_allows_splitting_and_whole_tokens_are_one_token():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert tokens.proof(PIECES)
    whole = tokens.whole_tokens(PIECES)
    assert len(whole) > 10_000 and all(len(sp.encode(t)) == 1 for t in whole)


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    count = tokens.Counter(PIECES)
    texts = [*odd_texts(4000, 1), None, "", "x" * 100_000]
    assert count.many(texts) == [len(sp.encode(t)) if t else 0 for t in texts]


def test_counts_survive_forgetting(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 16_000)
    monkeypatch.setattr(tokens, "GROUP_CHARS", 300)
    test_counts_equal_the_library()


def test_token_count_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(docs, PIECES).collect())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert got == sorted((i or 0, len((t or "").encode()), n := len(sp.encode(t)) if t else 0, n > 4096) for i, t, *_ in ROWS)
    assert tokens.count_tokens(docs.limit(0), PIECES).count() == 0


# ---- packing ----


def test_every_vocabulary_string_encodes_alone_as_one_token():
    plain = Tokenizer.from_file(BYTES)
    plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    vocabulary, added = packing.ranks(BYTES)
    words = {w: i for w, i in vocabulary.items()}
    texts = [(w.decode(), i) for w, i in words.items() if _utf8(w)]
    assert len(texts) > 49_000
    got = plain.encode_batch([t for t, _ in texts], add_special_tokens=False)
    assert all(e.ids == [i] for e, (_, i) in zip(got, texts, strict=True))


def _utf8(word):
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


def test_ids_equal_the_library():
    library, encoder = Tokenizer.from_file(BYTES), packing.Encoder(BYTES)
    texts = odd_texts(4000, 2) + ["", "some plain words and more words", " starts", "ends ", "a\nb c\n d"]
    for text, got in zip(texts, encoder.many(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(0, 300), max_size=40))
def test_patterns_hold_each_rest_once_and_fit(histogram):
    found = packing.patterns(histogram, 64)
    used = {}
    for count, held in found:
        assert count > 0 and sum(n * k for n, k in held) <= 64
        for n, k in held:
            used[n] = used.get(n, 0) + count * k
    assert used == {n: c for n, c in histogram.items() if c}
    assert len(found) <= 2 * 63
    at = packing.places(found)
    assert len(at["length"]) == sum(len(h) for _, h in found)


def slow_packs(histogram, size):
    packs = []
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            at = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
            if at is None or sum(packs[at]) + n > size:
                packs.append([n])
            else:
                packs[at].append(n)
    return sorted(sorted(p) for p in packs)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(0, 12), max_size=10))
def test_patterns_are_those_of_packing_one_rest_after_another(histogram):
    found = sorted(sorted(n for n, k in held for _ in range(k)) for count, held in packing.patterns(histogram, 32) for _ in range(count))
    slow = slow_packs(histogram, 32)
    assert len(found) == len(slow) and sorted(map(sum, found)) == sorted(map(sum, slow))


def test_repeated_rows_are_ranked_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 10)
    docs = spark.createDataFrame([(None, "the same words again")] * 400, "doc_id long, text string")
    got = packing.pack(docs, BYTES).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 400 and sum(r.length for r in got) <= 1024 * len({r.sequence_id for r in got})


def test_packing_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_GROUP", 7)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["alpha", "beta", "gamma", "délta", "x"]) for _ in range(rng.choice([0, 1, 3, 40, 200, 700, 1500, 3000]))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (7, texts[7]), (None, "null id"), (900, None), (901, "")]
    got = packing.pack(spark.createDataFrame([(*r, 5, "y") for r in rows], "doc_id long, text string, length int, sequence_id string"), BYTES).collect()
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t in rows:
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 0]
        for s in range(0, len(ids), 1024):
            part = np.array(ids[s : s + 1024], "<u4").tobytes()
            want.append((i, s, len(part) // 4, zlib.crc32(part), len(ids)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == sorted((-1 if w[0] is None else w[0], *w[1:]) for w in want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sorted(sequences) == list(range(len(sequences)))
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 1024) * 1.1 + 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


# ---- personal data ----

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_spans(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from([*"0123456789", *"..@@+-- ()_aé", "4387513035237269", "4387 5130 3523 7269", "a.b@c.d", "1.2.3.4", "+1 743 555", "255", "256"]), max_size=24).map("".join))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "+1" + "(" * 200_000, "a@" * 60_000, "1." * 100_000):
        pii.find_all([text], pii.trained())


def test_the_field_learns_its_table_and_finds_more():
    field = pii.trained()
    rows = pii.labelled()
    assert all(d.tolist() == g for d, (_, g) in zip(field.decode([s for s, _ in rows]), rows, strict=True))
    found = pii.find_all(["please ring (214) 555-0142 today", "write to mia (at) home (dot) org now", "call +1 (743) 555-3824 or the year 2024", "version 3.2 of 1999 , page 7"], field)
    assert [(k, b) for k, _, _, b in found[0]] == [("phone", False)]
    assert [(k, b) for k, _, _, b in found[1]] == [("email", False)]
    assert [(k, b) for k, _, _, b in found[2]] == [("phone", True)]
    assert found[3] == []


def test_neighbours_stay_apart_and_windows_have_any_length(monkeypatch):
    field = pii.trained()
    assert [s[:3] for s in pii.find_all(["ring (743) 555-3824, (743) 555-3825 now"], field)[0]] == [("phone", 5, 19), ("phone", 21, 35)]
    for entry, gap in (("(743) 555-{:04d}", " and then "), ("(743) 555-{:04d}", "\n"), ("743-555-{:04d}", "\n")):
        text = gap.join(entry.format(i) for i in range(2000))
        found = pii.find_all([text], field)[0]
        size = len(entry.format(0))
        assert [(s, e) for _, s, e, _ in found] == [(i * (size + len(gap)), i * (size + len(gap)) + size) for i in range(2000)], entry
    assert len(pii._windows(text)) == 1
    texts = ["of the (743) 555-3824 and " * n + "x" * n for n in range(0, 60, 7)] + ["", "write to ann (at) mail (dot) org", text[:9000]]
    whole = pii.find_all(texts, field)
    monkeypatch.setattr(pii, "STEP", 7)
    monkeypatch.setattr(pii, "CELLS", 50)
    monkeypatch.setattr(pii, "GROUP_CHARS", 100)
    assert pii.find_all(texts, field) == whole


def slow_decode(field, shapes):
    """The best path by enumeration of all states of short windows."""
    import itertools

    scores = field.scores(shapes)
    start = pii.allowed()[0]
    return max(itertools.product(range(pii.STATES), repeat=len(shapes)), key=lambda p: start[p[0]] + scores[range(len(p)), p].sum() + sum(field.move[a, b] for a, b in zip(p, p[1:])))


def test_decoding_equals_enumeration():
    field = pii.trained()
    for text in ("06 12 34", "at 8.8", "+ 1 (7", "ann at mail"):
        shapes = pii.tokens(text, 0, len(text))[0][:5]
        assert tuple(field.decode([shapes])[0].tolist()) == slow_decode(field, shapes)


def made_up(rng):
    """A line of words with one item of personal data that no base pattern takes, or with numbers that are none."""
    words = lambda n: " ".join(rng.choice("the of and le die von to an was is on mit que por".split()) for _ in range(n))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 8)))
    kind = rng.choice(["phone", "phone", "email", "none", "none"])
    made = {
        "phone": rng.choice([f"({rng.randrange(200, 999)}) 555-{d(4)}", f"{rng.randrange(200, 999)}-555-{d(4)}", f"{rng.randrange(200, 999)}.555.{d(4)}", f"0{rng.randrange(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"]),
        "email": rng.choice([f"{name()} (at) {name()} (dot) org", f"{name()} at {name()} dot com", f"{name()} [at] {name()} [dot] net"]),
        "none": rng.choice([f"{rng.randrange(1900, 2030)}", f"chapter {d(1)}.{d(1)}", f"{d(2)} of {d(3)}", f"id {d(5)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(4)}-{d(2)}-{d(2)}"]),
    }[kind]
    before = words(rng.randrange(1, 9)) + " "
    return before + made + " " + words(rng.randrange(1, 9)), (kind, len(before), len(before) + len(made))


def test_recall_and_precision_on_made_up_lines():
    rng = random.Random(12)
    lines = [made_up(rng) for _ in range(600)]
    found = pii.find_all([t for t, _ in lines], pii.trained())
    right = sum(want in [s[:3] for s in got] for (_, want), got in zip(lines, found, strict=True) if want[0] != "none")
    wanted = sum(want[0] != "none" for _, want in lines)
    false = sum(s[:3] != want for (_, want), got in zip(lines, found, strict=True) for s in got)
    assert right >= 0.95 * wanted and false <= 0.05 * wanted, (right, wanted, false)


def test_pii_rows_and_redaction(spark):
    rows = [(1, "mail a@b.org or +1 (743) 555-3824", 3), (2, None, None), (3, "", 0), (None, "10.0.0.1 x", 9), (1, "mail a@b.org or +1 (743) 555-3824", 3)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, n_chars long, spans string")
    got = sorted((r.doc_id or 0, [(s.kind, s.start, s.end, s.base) for s in r.spans]) for r in pii.find(docs).collect())
    one = [("email", 5, 12, True), ("phone", 16, 33, True)]
    assert got == [(0, [("ip", 0, 8, True)]), (1, one), (1, one), (2, []), (3, [])]
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and dict(clean.dtypes) == dict(docs.dtypes)
    assert sorted((r.doc_id or 0, r.text, r.n_chars) for r in clean.where("text is not null").collect()) == [(0, "[IP] x", 6), (1, t := "mail [EMAIL] or [PHONE]", len(t)), (1, t, len(t)), (3, "", 0)]
    assert clean.where("text is null").first().n_chars is None
    assert pii.find(docs.limit(0)).count() == 0 and pii.redact(docs.limit(0)).count() == 0


# ---- main text ----

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=a>menu one</a><li><a href=b>menu two</a></ul></nav><div class="ad banner">Buy now, a very long advert text that goes on and on and on</div>
<div class="cookie-notice">We use cookies</div><article class="post"><h1>The &amp; title</h1><p><b>First line<br>goes   on.<p>Second &eacute; &#233; &lt;b&gt;.</p><p>No.</p><ul><li>point one<li>point two</ul>
<aside>see also</aside><form><p>your name</p></form><div class="comments"><p>First comment, a long one with many words in it</p></div></article><aside class="sidebar"><p>Side text</p></aside><footer>&copy; me</footer></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE).split("\n") == ["The & title", "First line goes on.", "Second é é <b>.", "No.", "point one", "point two"]
    for empty in (None, "", "   ", "<html></html>", "<nav>only a menu</nav>"):
        assert html.main_text(empty) == ""
    plain = "<body><div id=menu><a>x</a> <a>y</a></div><div><p>" + "A long paragraph of an unmarked article. " * 5 + "</p><p>And its end.</p></div><div><a href=x>link</a></div></body>"
    assert html.main_text(plain).split("\n")[1] == "And its end."
    assert html.main_text("<article>a<p>b &amp") == "a\nb &"


def test_main_text_keeps_every_part_of_a_story():
    long = "A long paragraph of the story, with many words in it. " * 6
    menu = "<div><a href=x>one</a></div><div><a href=y>two</a></div>"
    teaser = html.main_text(f"<body>{menu}<main><p>{long}</p><p>Short.</p><article><p>An unclassed teaser</p></article></main></body>").split("\n")
    assert teaser[:2] == [long.strip(), "Short."]
    for tag in ("article", "section", "div"):
        parts = html.main_text(f"<body>{menu}<{tag}><p>{long * 2}</p></{tag}><{tag}><p>{long}</p><p>The end.</p></{tag}>{menu}</body>")
        assert parts.split("\n") == [(long * 2).strip(), long.strip(), "The end."], tag
    one = html.main_text(f"<body>{menu}<article><h1>Title</h1><div><p>{long}</p></div><p>End.</p></article><div><a href=z>next</a></div></body>")
    assert one.split("\n") == ["Title", long.strip(), "End."]


def test_main_text_keeps_elements_with_slug_ids():
    words = "with the words of a paragraph that belongs to the story"
    slugs = f"""<h2 id="social-impact">Social impact</h2><p>one {words}</p><h3 id="login-problems">Login problems</h3><p id="notice-period">two {words}</p>
    <section id="related-work" class="social-impact"><h2>Related work</h2><p>three {words}</p></section>"""
    ads = '<div class="ad">buy</div><div class="box ad-slot-2">buy</div><div id="comments"><p>mine</p></div><p class="ad">buy</p><ul class="share-buttons"><li>send</li></ul>'
    for page in (f"<article>{slugs}{ads}</article>", f"<main>{slugs}{ads}</main>", f'<article class="post category-sponsorship" id="comments-on-the-budget">{slugs}{ads}</article>'):
        got = html.main_text(f"<body>{page}</body>").split("\n")
        assert got == ["Social impact", f"one {words}", "Login problems", f"two {words}", "Related work", f"three {words}"], page
    assert html.main_text(f'<body><div id="site-footer"><p>{words}</p></div><div>{slugs}</div></body>').startswith("Social impact")


def test_main_text_survives_layout_classes():
    words = "with the words of a paragraph that belongs to the story"
    body = f"<h1>Title</h1><p>one {words}</p><p>two {words}</p>"
    for name in ("no-sidebar", "with-sidebar content", "comments-open hentry", "post social-science", "content has-sidebar-right", "td-menu-background", "wrapper header-fixed", "alert-free"):
        for page in (f'<div class="{name}">{body}</div>', f'<div class="{name}"><article>{body}</article></div>', f'<body><div id=menu>x</div><section class="{name}">{body}</section></body>'):
            assert html.main_text(page).split("\n") == ["Title", f"one {words}", f"two {words}"], (name, page)
    assert html.main_text(f'<div class="sidebar"><article>{body}</article></div>').startswith("Title")
    cards = f'<div class="sidebar"><article><p>teaser {words}</p></article></div><div id="comments"><article class="comment"><p>mine {words} {words}</p></article></div>'
    assert html.main_text(f"<body><article>{body}</article>{cards}</body>") == html.main_text(f"<article>{body}</article>")
    assert html.main_text('<div class="ad">only an advert</div>') == ""


def test_link_runs_inside_an_article_are_menus_by_their_ratios():
    words = "a paragraph of the story with many words in it that goes on for a while " * 3
    menu = "<ul>" + "".join(f"<li><a href=/{i}>part {i}</a></li>" for i in range(5)) + "</ul>"
    page = f"<article><h1><a href=/>Title</a></h1><p>{words}</p>{menu}<p><a href=x>One link.</a></p>plain<p>{words}</p></article>"
    got = html.main_text(page).split("\n")
    assert got == ["Title", words.strip(), "One link.", "plain", words.strip()]
    few = page.replace(menu, "<ul><li><a href=/1>part 1</a><li><a href=/2>part 2</a></ul>")
    assert "part 1\npart 2" in html.main_text(few)


def test_main_text_takes_linear_time():
    import time

    for page in ("<b>" * 100_000 + "text", "<div>" * 50_000 + "text" + "</div>" * 50_000, "<b>" * 50_000 + "<hr>" * 50_000, "<div><article>" + "<b>x" * 50_000 + "</div>" * 50_000, "<p>a<li>b" * 40_000, "<div class=ad>" * 30_000 + "text"):
        began = time.process_time()
        html.main_text(page)
        assert time.process_time() - began < 6, page[:30]


def test_content_lines_equal_a_slow_version():
    import math

    rng = random.Random(4)
    for _ in range(40):
        lines = [("x" * rng.choice([1, 5, 40, 200, 900]), rng.randrange(0, 9), 0, False) for _ in range(rng.randrange(1, 40))]
        ratios = [len(t) / max(1, n) for t, n, *_ in lines]
        mean = sum(ratios) / len(ratios)
        least = html.THRESHOLD * math.sqrt(sum((r - mean) ** 2 for r in ratios) / len(ratios))
        weight = lambda i, j: math.exp(-0.5 * ((i - j) / html.SIGMA) ** 2) if abs(i - j) <= 3 * html.SIGMA else 0.0
        n = range(len(lines))
        slow = [sum(weight(i, j) * ratios[j] for j in n) / sum(weight(i, j) for j in n) for i in n]
        content, strong = html.content_lines(lines)
        assert all(c == (s >= least) or abs(s - least) < 1e-9 for c, s in zip(content.tolist(), slow, strict=True))
        assert strong.tolist() == [bool(c) and r >= least for c, r in zip(content, ratios, strict=True)]


def test_smoothing_keeps_a_constant():
    assert np.allclose(html.smooth(np.full(9, 3.0)), 3.0)


def test_page_rows(spark):
    rows = [(1, "u", PAGE, "z"), (None, None, None, None), (2, "v", "", ""), (1, "u", PAGE, "z"), (3, "w", "<p>" + "x " * 50_000, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (None, 2)} == {""}
    assert html.extract(pages.limit(0)).count() == 0


# ---- media ----


def test_wav_round_trip_and_payload():
    for n in (0, 1, 63, 64, 65, 4000):
        data = media.payload("x" * n)
        assert len(data) % 64 == 0 and len(data) >= 64 and data.rstrip(b"\0") == b"x" * n
        assert media.from_wav(media.to_wav(data)) == (media.RATE, data)
    assert media.from_wav(media.to_wav(b"abc"))[1] == b"abc"
    with pytest.raises(ValueError):
        media.from_wav(media.to_wav(b"abcd" * 16)[:-8])


def test_resampling_equals_filtering_then_dropping():
    x = np.random.default_rng(1).standard_normal(501).astype(np.float32)
    slow = np.convolve(x, media._half_band(), "valid")[::2]
    assert np.allclose(media.resample_half(x)[: len(slow)], slow, atol=1e-5)


def test_features_do_not_depend_on_steps(monkeypatch):
    data = media.payload("the quick brown fox " * 3000)
    whole = media.log_mel(data)
    monkeypatch.setattr(media, "STEP", 37)
    parts = media.log_mel(data)
    assert (whole[0] == parts[0]).mean() > 0.9999 and np.allclose(whole[1], parts[1], atol=0.05)


def test_a_tone_lands_in_its_band_and_loud_parts_are_segments():
    t = np.arange(32_000) / media.RATE
    loud = np.where((t > 1) & (t < 2), 100, 2) * np.sin(2 * np.pi * 500 * t)
    bands, energy = media.log_mel((128 + loud).astype(np.uint8).tobytes())
    spans = media.segments(energy)
    assert len(spans) == 1 and abs(spans[0][0] * media.HOP / media.HALF_RATE - 1) < 0.1 and abs(spans[0][1] * media.HOP / media.HALF_RATE - 2) < 0.1
    centre = bands[spans[0][0] + 3].argmax()
    assert 3 <= centre <= 8


def test_media_rows(spark):
    docs = spark.createDataFrame([(1, "abc" * 9000, "q"), (2, None, None), (3, "", ""), (4, "abc" * 9000, "r"), (None, "é", "")], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in media.encode(docs).collect()}
    for i, text in ((1, "abc" * 9000), (2, ""), (3, ""), (None, "é")):
        r, data = got[i], media.payload(text)
        assert r.n_bytes == len(text.encode()) and r.payload_bytes == len(data)
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-64:])
        assert media.from_wav(bytes(r.media))[1] == data and r.media_sha256 == hashlib.sha256(bytes(r.media)).hexdigest() and r.media_bytes == len(r.media)
    assert got[1].feature == got[4].feature and got[2].feature == got[3].feature
    first = got[1].clips
    tensor = media.tensors(pa.array([c.log_mel for c in first], pa.list_(pa.int16())))
    bands, energy = media.log_mel(media.payload("abc" * 9000))
    assert tensor.type.shape == [media.CLIP, media.BANDS] and len(tensor) == len(first) > 1 and first[0].start_s == 0
    assert (tensor.to_numpy_ndarray().reshape(-1, media.BANDS)[: len(bands)] == bands).all()
    assert [(round(s.start_s, 6), round(s.end_s, 6)) for s in got[1].segments] == [(round(a * media.HOP / media.HALF_RATE, 6), round(((b - 1) * media.HOP + media.FRAME) / media.HALF_RATE, 6)) for a, b in media.segments(energy)]
    assert media.encode(docs.limit(0)).count() == 0


def test_log_mel_equals_direct_transforms():
    data = media.payload("Some text with é and more words, twice over. " * 60)
    got, energy = media.log_mel(data)
    x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    padded = np.concatenate([np.zeros(media.TAPS), x, np.zeros(media.TAPS + 4 * media.FRAME)])
    half = np.array([sum(t * padded[2 * i + k] for k, t in enumerate(media._half_band().astype(float))) for i in range(-(-len(x) // 2))])
    half = np.concatenate([half, np.zeros(media.FRAME)])
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(media.HALF_RATE / 2) * i / (media.BANDS + 1) / 2595) - 1) for i in range(media.BANDS + 2)]
    n = np.arange(media.FRAME)
    for at in range(len(got) - 1):
        frame = half[at * media.HOP : at * media.HOP + media.FRAME]
        power = [abs((frame * np.hanning(media.FRAME) * np.exp(-2j * np.pi * k * n / media.FRAME)).sum()) ** 2 for k in range(media.FRAME // 2 + 1)]
        for band in range(media.BANDS):
            lo, mid, hi = edges[band : band + 3]
            total = sum(p * max(0.0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) for p, f in zip(power, np.arange(media.FRAME // 2 + 1) * media.HALF_RATE / media.FRAME, strict=True))
            assert abs(got[at, band] - 16 * np.log(total + 1e-6)) <= 0.75
        assert abs(energy[at] - np.log((frame**2).sum() + 1e-6)) < 0.03


def test_hysteresis_equals_a_loop():
    rng = np.random.default_rng(2)
    for _ in range(50):
        e = np.round(rng.normal(size=rng.integers(2, 60)), 2)
        high, low = e.mean() + media.OPEN * e.std(), e.mean() + media.CLOSE * e.std()
        state, spans = False, []
        for i, v in enumerate(e):
            now = v >= high or state and v >= low
            if now and not state:
                spans.append([i, i])
            if now:
                spans[-1][1] = i + 1
            state = now
        assert media.segments(e) == [tuple(s) for s in spans]


# ---- licenses ----


def test_licenses_are_found_whole_and_changed():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        found = [f for f in scanner.scan("foo bar baz " * 30 + text + " qux quux" * 30) if f[0].split(":")[0] == name.split(":")[0]]
        assert found and found[0][1] >= 0.8 and found[0][2] == 90, name
    for said, want in (("Released under the MIT Licence.", "MIT"), ("Released under a MIT License.", "MIT"), ("Licensed under Apache License, Version 2.0.", "Apache-2.0"), ("licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0")):
        assert [f[0].split(":")[0] for f in scanner.scan("of the " + said + " and so on")] == [want], said
    assert scanner.scan("a text about licensing and rights , all of them reserved") == []
    assert licenses.Scanner({}).scan("MIT License") == []
    for bad in ({"a": ""}, {"a": "one"}, {"a": "..."}):
        with pytest.raises(ValueError):
            licenses.Scanner(bad)


def test_retrieval_finds_what_an_exhaustive_scan_finds():
    scanner = licenses.Scanner()
    rng = random.Random(7)
    found = wanted = 0
    for name, text in licenses.TEMPLATES.items():
        for _ in range(12):
            parts = text.split()
            for _ in range(rng.randrange(0, 1 + len(parts) // 30 + (len(parts) > 4))):
                parts[rng.randrange(len(parts))] = rng.choice(["zzz", "the", ""])
            page = "x y the under " * rng.randrange(1, 60) + " ".join(parts) + " q r license version" * 30
            fast, slow = scanner.scan(page), scanner.scan(page, exhaustive=True)
            assert set(fast) <= set(slow), name
            found, wanted = found + len(fast), wanted + len(slow)
    assert wanted > 400 and found >= 0.995 * wanted, (found, wanted)


def test_scans_do_not_depend_on_the_texts_beside(monkeypatch):
    rng = random.Random(9)
    texts = [None, "", "MIT License"] + ["x y " * rng.randrange(60) + rng.choice(list(licenses.TEMPLATES.values())).replace("and", "or") + " z" * rng.randrange(60) for _ in range(60)]
    scanner = licenses.Scanner()
    alone = [scanner.scan(t) for t in texts]
    assert scanner.many(texts) == alone and sum(map(bool, alone)) > 40
    monkeypatch.setattr(licenses, "STEP", 64)
    monkeypatch.setattr(licenses, "GROUP_WORDS", 300)
    monkeypatch.setattr(licenses, "REMEMBERED", 20)
    assert scanner.many(texts) == alone


def test_license_rows(spark):
    rows = [(1, "x. Released under the MIT License.", 2.0), (2, None, None), (3, "", 0.0), (None, "All rights reserved.", 1.0), (1, "x. Released under the MIT License.", 2.0), (5, "w " * 40_000 + licenses.TEMPLATES["MIT:text"], 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, containment double")
    got = sorted((r.doc_id or 0, r.license, r.form, r.start_word) for r in licenses.scan(docs).collect())
    assert got == [(0, "all-rights-reserved", "notice", 0), (1, "MIT", "name", 4), (1, "MIT", "name", 4), (5, "MIT", "text", 40_000)]
    assert licenses.scan(docs.limit(0)).count() == 0
