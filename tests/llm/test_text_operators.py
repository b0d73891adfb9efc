"""Main text, SentencePiece and URL rules."""

from __future__ import annotations

import random
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F

from factorloom.llm import html_text, spm, urlrules
from factorloom.llm.queries import url_rules

MODEL = public_tokenizers.path("piece_bpe_32k.model")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">About</a></li></ul></nav><div class="cookie-notice">We use cookies.</div>
<article><h1>A  headline</h1><p>First paragraph, with commas, an &amp; and a <a href="/x">link</a>.<p>Second<br>paragraph &eacute;&#233;
with <b>bold</b> words, quite long, so that it counts.</p><ul><li>one</li><li>two</li></ul></article>
<aside>Sidebar</aside><div id="comments"><p>First, a comment, and another one, long enough to count, by a reader.</p></div>
<form><input><p>Subscribe</p></form><footer>&copy; somebody</footer></body></html>"""


def test_main_text():
    want = "A headline First paragraph, with commas, an & and a link. Second paragraph éé with bold words, quite long, so that it counts. one two"
    assert html_text.main_text(PAGE) == want
    assert html_text.main_text("") == "" and html_text.main_text("<nav><a>x</a></nav>") == ""
    assert html_text.main_text("<p>just text, cut <b") == "just text, cut"
    deep = "<div>" * 20_000 + "<p>deep text, and some more of it.</p>"
    assert html_text.main_text(deep) == "deep text, and some more of it."
    assert html_text.main_text("<div>x, " * 20_000).count("x") == 20_000


ARTICLE = [f"Paragraph {k} of the article, which has some words, commas, and a full stop at its end, as usual." for k in range(6)]
BODY = "".join(f"<p>{x}</p>" for x in ARTICLE)
MENU = '<nav><a href="/">Home</a><a href="/b">About us</a></nav>'
REAL = {
    "no end of head": f"<html><head><title>x</title><meta charset=utf-8><body>{MENU}<article>{BODY}</article><footer>c</footer>",
    "no head's end, no body": f"<html><head><title>x</title><div>{MENU}<article>{BODY}</article></div><footer>c</footer>",
    "one form": f"<body><form id=aspnetForm>{MENU}<div>{BODY}</div><input></form><footer><p>Copyright, all of it.</p></footer></body>",
    "open form": f"<body><div class=top><form><input></div><div class=content>{BODY}</div></body>",
    "open nav": f"<body><div class=top><nav><a href=/>Home</a></div><div class=content>{BODY}</div></body>",
    "social science": f"<body>{MENU}<div class='post social-science'>{BODY}</div><div class='social-links'><p>Share this, please, on all of them.</p></div></body>",
    "comment-free": f"<body>{MENU}<div class='entry-content comment-free'>{BODY}</div><div class=comments><p>First, a comment, and another.</p></div></body>",
    "skip-lazy": f"<body>{MENU}<div class='skip-lazy'>{BODY}</div></body>",
    "named like a sidebar": f"<body>{MENU}<div class='sidebar-content'>{BODY}</div><footer><p>Copyright, all of it.</p></footer></body>",
    "commentlist": f"<body>{MENU}<div class=post><div>{BODY}</div><ol class=commentlist><li><p>First, a comment, and another, of some length.</p></li></ol><div class=adsbygoogle>Buy this, now, and that.</div></div></body>",
    "short last paragraph": f"<body>{MENU}<div><div>{BODY}</div><p>The end.</p></div></body>",
}


@pytest.mark.parametrize("name", list(REAL))
def test_main_text_of_real_html(name):
    want = " ".join(ARTICLE) + (" The end." if name == "short last paragraph" else "")
    assert html_text.main_text(REAL[name]) == want


LAST = {
    "section": "<section><h2>Conclusion</h2>It ends here.</section>",
    "div": "<div>It ends here.</div>",
    "list": "<ul><li>one thing</li><li>another thing</li></ul>",
    "table": "<table><tr><td>cell</td><td>other cell</td></tr></table>",
    "figure": "<figure><img src=x><figcaption>What it shows.</figcaption></figure>",
}


@pytest.mark.parametrize("name", list(LAST))
def test_parts_beside_the_container_stay(name):
    page = f"<html><body>{MENU}<div id=content><h3>Before it</h3><div>{BODY}</div>{LAST[name]}<div>{BODY}</div>{LAST[name]}</div><footer>c</footer></body>"
    part = " ".join(re.sub("<[^>]*>", " ", LAST[name]).split())
    assert html_text.main_text(page) == f"Before it {' '.join(ARTICLE)} {part} {' '.join(ARTICLE)} {part}"


def test_time_is_linear_in_lists():
    import time

    took = []
    for n in (4000, 16_000):
        began = time.time()
        html_text.main_text("<ul>" + "<span>" * n + "<li>item, of it" * n)
        took.append(time.time() - began)
    assert took[1] < 10 * max(took[0], 0.05)


def test_only_links_and_notices_have_no_text():
    assert html_text.main_text("<body><footer><p>Copyright, all rights, reserved, as ever.</p></footer></body>") == ""
    assert html_text.main_text(f"<body>{MENU}<div hidden><p>Nobody, ever, sees, this text of some length.</p></div></body>") == ""


def test_time_is_linear_in_depth_and_length():
    import time

    began = time.time()
    page = "<article>" + "<span>" * 300 + "".join("<p>a, b</p>" for _ in range(20_000))
    assert html_text.main_text(page).startswith("a, b a, b") and time.time() - began < 10


def test_words_of_generated_pages():
    """Word precision and recall over random layouts, by an independent count of the words that were put in the article."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    sentence = lambda n: ", ".join(" ".join(word() for _ in range(rng.randrange(3, 9))) for _ in range(n)) + "."
    hits = put = got = 0
    for k in range(150):
        parts = [sentence(rng.randrange(2, 6)) for _ in range(rng.randrange(3, 12))]
        inner = "".join(rng.choice(["<p>{}</p>", "<p>{}<p>", "<blockquote><p>{}</p></blockquote>", "<p>{}<br></p>"]).format(x) for x in parts)
        article = rng.choice(["<article>{}</article>", "<div class='post-body'>{}</div>", "<main><div>{}</div></main>", "<section id=story>{}</section>"]).format(inner)
        links = "".join(f"<li><a href=/{word()}>menu{k} {word()}</a></li>" for _ in range(rng.randrange(3, 15)))
        clutter = [
            f"<ul class='main-menu'>{links}</ul>",
            f"<div class=sidebar><p>side{k}, {sentence(1)}</p></div>",
            f"<div class='cookie-notice'><p>cookie{k} {sentence(1)}</p></div>",
            f"<div id=comments><p>comment{k} {sentence(2)}</p></div>",
            f"<form><p>form{k} {sentence(1)}</p><input></form>",
            f"<footer><p>foot{k} {sentence(1)}</p></footer>",
        ]
        rng.shuffle(clutter)
        at = rng.randrange(len(clutter) + 1)
        head = rng.choice(["<html><head><title>t</title></head><body>", "<head><title>t</title>", "", "<html><body>"])
        text = html_text.main_text(head + "".join(clutter[:at]) + article + "".join(clutter[at:]))
        want, found = Counter(" ".join(parts).split()), Counter(text.split())
        hits, put, got = hits + sum((want & found).values()), put + sum(want.values()), got + sum(found.values())
    assert hits / got > 0.99 and hits / put > 0.99, (hits, got, put)


def test_main_text_of_pages(spark):
    pages = spark.read.parquet(f"{DATA}/sf0.01/pages.parquet")
    rows = pages.select("html", html_text.main_texts(F.col("html")).alias("t")).collect()
    assert sum(bool(r["t"]) for r in rows) > 0.9 * len(rows)
    for r in rows:
        assert r["t"] == " ".join(r["t"].split()) and "<p" not in r["t"]
        for menu in re.findall(r'<li><a href="[^"]*">([^<]*)</a></li>', r["html"])[:1]:
            assert not r["t"].startswith(menu + " " + menu)


def test_main_text_edge_cases(spark):
    df = spark.createDataFrame([(None,), ("",), (PAGE,), (PAGE,)], "html string")
    got = [r[0] for r in df.select(html_text.main_texts(F.col("html"))).collect()]
    assert got[:2] == ["", ""] and got[2] == got[3] != ""
    assert df.limit(0).select(html_text.main_texts(F.col("html"))).collect() == []


def test_pieces_are_the_librarys():
    rng = random.Random(2)
    own, lib = spm.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    bits = ["the ", "ing", " ", "  ", "é", "日本", "🙂", "▁", "\n", "1", "a", "Q", "...", "'", "ß", "\t", "qzx", "<s>", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 40))) for _ in range(1500)] + ["", "x" * 3000, "ab " * 2000]
    got = own.encode(texts)
    assert [memoryview(x).cast("i").tolist() for x in got] == [lib.encode(t) for t in texts]
    import numpy as np

    ids = [np.frombuffer(x, dtype="<i4") for x in got]
    assert [own.decode(x) for x in ids] == [lib.decode(x.tolist()) for x in ids]


def test_words_of_one_trie_are_the_librarys():
    own = spm.Pieces(MODEL)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    words = sorted({"\u2581the", "\u2581then", "\u2581there", "\u2581thermal", "\u2581xylophone"})
    for word, ids in own.walk(words):
        found = memoryview(ids).cast("i").tolist()
        assert found == lib.encode(word[1:]) and "".join(own.names[i] for i in found) == word


def _varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _message(*parts):
    """Fields (number, text, bytes, float or whole number) in the wire format of protocol buffers."""
    out = b""
    for n, x in parts:
        if isinstance(x, float):
            out += _varint(n << 3 | 5) + struct.pack("<f", x)
        elif isinstance(x, int):
            out += _varint(n << 3) + _varint(x)
        else:
            x = x.encode() if isinstance(x, str) else x
            out += _varint(n << 3 | 2) + _varint(len(x)) + x
    return out


def _score_model(scores, with_bytes):
    """A model file of scores, written by hand: the pieces and what they score."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if with_bytes else []
    pieces += [(p, x, 1) for p, x in scores.items()]
    settings = _message((3, 1), (35, int(with_bytes)))
    spaces = _message((1, "identity"), (3, 1), (4, 0), (5, 1))
    return b"".join(_message((1, _message((1, p), (2, x), (3, k)))) for p, x, k in pieces) + _message((2, settings), (3, spaces))


@pytest.mark.parametrize("with_bytes", [True, False])
def test_scores_decide_in_models_of_scores(tmp_path, with_bytes):
    rng = random.Random(4)
    scores = {c: -rng.uniform(6, 9) for c in "\u2581abcdef1."}
    for _ in range(150):
        body = "".join(rng.choices("abcdef", k=rng.randrange(2, 6)))
        scores.setdefault(rng.choice(["", "\u2581"]) + body, -rng.uniform(3, 14))
    scores["\u2581bxa"] = -5.0  # holds a character that is no piece
    path = tmp_path / "scores.model"
    path.write_bytes(_score_model(scores, with_bytes))
    own, lib = spm.Pieces(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["".join(rng.choices(["a", "b", "c", "d", "e", "f", "bxa", " ", "1", ".", "xx", "\u65e5"], k=rng.randrange(60))) for _ in range(800)] + ["", "abc" * 2000]
    got = [memoryview(x).cast("i").tolist() for x in own.encode(texts)]
    assert got == [lib.encode(t) for t in texts]
    # a changed score changes the segmentation
    changed = {p: x - 20.0 if len(p) > 2 else x for p, x in scores.items()}
    path.write_bytes(_score_model(changed, with_bytes))
    other = [memoryview(x).cast("i").tolist() for x in spm.Pieces(str(path)).encode(texts)]
    assert other == [sentencepiece.SentencePieceProcessor(model_file=str(path)).encode(t) for t in texts] and other != got
    assert not spm.by_scores(open(MODEL, "rb").read())


def test_long_words_are_not_remembered():
    own = spm.Pieces(MODEL)
    own.encode(["y" * 5000 + " short"])
    own.encode(["short"])
    assert max(map(len, own.memory.newer)) <= own.memory.longest


def test_encode_and_decode(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = spm.encode(docs, MODEL).join(docs, "doc_id").select("text", spm.decode(F.col("ids"), MODEL).alias("back")).collect()
    assert all(r["text"] == r["back"] for r in got)
    df = spark.createDataFrame([(1, None), (None, ""), (2, "a"), (2, "a")], "doc_id long, text string")
    assert sorted(len(r["ids"]) for r in spm.encode(df, MODEL).collect()) == [0, 0, 1, 1]
    assert spm.encode(df.limit(0), MODEL).collect() == []
    nothing = spark.createDataFrame([(None,), ([],)], "ids array<int>")
    assert [r[0] for r in nothing.select(spm.decode(F.col("ids"), MODEL)).collect()] == [None, ""]


def _glob(rule):
    out, k = "", 0
    while k < len(rule.glob):
        if rule.glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif rule.glob[k] == "*":
            out, k = out + "[^/?]*", k + 1
        else:
            out, k = out + re.escape(rule.glob[k]), k + 1
    return re.compile(out, re.S)


def test_automaton_is_every_rule_by_itself():
    rng = random.Random(3)
    rules = url_rules() + [urlrules.glob_rule("**", "".join(rng.choices(["a", "/", "*", "**", "b"], k=rng.randrange(1, 9))), "block") for _ in range(60)]
    automaton = urlrules.Automaton(rules)
    assert automaton.words > 1
    texts = [".x.example.com?/en/7a", ".example.net?/de/8", ".net?/de/1", ".a?/calendar/x", "?", ".é?/日本"]
    texts += ["." + "".join(rng.choices("ab.", k=3)) + "?/" + "".join(rng.choices("ab/", k=rng.randrange(9))) for _ in range(400)]
    want = []
    for t in texts:
        fits = [k for k, r in enumerate(rules) if _glob(r).fullmatch(t)]
        want.append(min(fits, key=lambda k: (-rules[k].weight, k)) if fits else -1)
    assert automaton.winners(texts).tolist() == want
    assert [automaton.winners([t])[0] for t in texts] == want  # one by one


def test_long_urls_take_no_longer_for_each_character():
    import time

    automaton = urlrules.Automaton(url_rules())
    began = time.time()
    found = automaton.winners([".a.com?/en/" + "x" * 400_000, ".a.org?/b/" + "y" * 400_000 + "/print/x", ".b?/"])
    assert time.time() - began < 5 and [url_rules()[k].verdict if k >= 0 else None for k in found] == ["block", "block", None]


def test_verdicts(spark):
    urls = {
        "https://www.Example.com/en/71#top": ("www.example.com", "/en/71", "example.com/en/7", "allow"),
        "https://other.com/en/1?x": ("other.com", "/en/1", "com/en/", "block"),
        "https://example.net/de/8": ("example.net", "/de/8", "example.net/de/8", "block"),
        "http://a.net/de/9": ("a.net", "/de/9", "net/de/", "allow"),
        "http://xexample.com/en/7": ("xexample.com", "/en/7", "com/en/", "block"),
        "http://a.org/print/x": ("a.org", "/print/x", None, "block"),
        "http://a.b?u=://c/d": ("a.b", "", None, "allow"),
        "no scheme.com/en/": ("", "", None, "allow"),
        "x://h\n.com/en/": ("h\n.com", "/en/", "com/en/", "block"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, Host int")
    got = urlrules.judge(df, url_rules(), "allow")
    assert {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == urls
    assert urlrules.judge(df.limit(0), url_rules(), "allow").collect() == []
    assert {r["verdict"] for r in urlrules.judge(df, [], "block").collect()} == {"block"}
    long = spark.createDataFrame([("http://a.com/en/" + "x" * 100_000,)], "url string")
    assert urlrules.judge(long, url_rules(), "allow").first()["verdict"] == "block"
    with pytest.raises(ValueError):
        urlrules.host_rule("*.com", "/", "block")
