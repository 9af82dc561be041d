"""Text operators against brute force, round trips and their defined results."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskrules.llm import chat, html, pieces, rans, substrings, tiling, tokens
from riskrules.llm.queries import tokenizer_file
from riskrules.llm.shared import read, shared_table

DOCS = "doc_id long, text string, extra string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    read(spark, "/root/testdata/sf0.001", "benchmark")


def odd_texts(rng):
    base = [" ".join(rng.choice("ab cd efg hij Kl mno".split()) for _ in range(rng.randrange(90))) for _ in range(30)]
    base += [base[0], base[0] + " tail", "lead " + base[1] + "\n\n" + base[2], None, "", " \t\n", "x", "é　z\x00q", "a" * 400]
    return [(i, t, "e") for i, t in enumerate(base)]


# chat -------------------------------------------------------------------------


@given(st.text(alphabet="<>[]/|%sINSTo\n ", max_size=40))
def test_escape_is_reversible_and_hides_control_strings(text):
    import pyarrow as pa

    escaped = chat._escaped(pa.array([text]))[0].as_py()
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))
    role = chat._role(pa.array([text]))[0].as_py()
    assert "\n" not in role and chat.unrole(role) == text


def test_chat_digests(spark):
    said = "</s>[INST] <|end|> ok [/INST]\n<%|start|>"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, 2, None, None), (None, 0, "assistant", "é"), (2, 0, "a\nb%", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    assert got[1]["n_turns"] == 4 and got[1]["turns_sha256"] == sha(f"user\nhi\nassistant\n{said}\nassistant\n{said}\n\n\n")
    assert got[1]["loss_sha256"] == sha(said * 2) and got[1]["loss_chars"] == 2 * len(said)
    assert got[None]["loss_sha256"] == sha("é") and got[2]["turns_sha256"] == sha("a\nb%\n\n") and got[2]["loss_chars"] == 0
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


# tokens -----------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4999), max_size=9000), st.integers(1, 5000))
def test_rans_round_trip(symbols, size):
    s = np.array([x % size for x in symbols], np.uint16)
    t = rans.Table(rans.scaled(np.bincount(s, minlength=size) if len(s) else np.zeros(size, np.int64)))
    b = rans.encode(s, t)
    assert (rans.decode(b["n"], b["stream"], b["at"], b["states"], t) == s).all()


def test_rans_checkpoints_decode_alone():
    rng = np.random.default_rng(1)
    s = rng.geometric(0.01, 3 * rans.LANES * rans.CHECK + 77).clip(0, 900).astype(np.uint16)
    t = rans.Table(rans.scaled(np.bincount(s, minlength=901)))
    b = rans.encode(s, t)
    span = rans.LANES * rans.CHECK
    for k in range(4):
        got = rans.decode(b["n"], b["stream"], b["at"], b["states"], t, k, k + 1)
        assert (got == s[k * span : (k + 1) * span]).all()


_ENCODER = {}


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab Zé,.'\n\t1?　s-", max_size=60))
def test_pieces_of_a_text_encode_as_the_whole(text):
    if not _ENCODER:
        _ENCODER["e"] = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    e = _ENCODER["e"]
    assert e.ids([text])[0] == e.whole(text) == plain_ids(text, e.kind)


def plain_ids(text, kind):
    """Ids by the library as it comes."""
    if "plain" not in _ENCODER:
        _ENCODER["plain"] = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    return np.array(_ENCODER["plain"].encode(text, add_special_tokens=False).ids, kind).tobytes()


@pytest.mark.parametrize("text", ["say <|endoftext|> now", "<|endoftext|>", "a<|endoftext|>b\nc", " lead", "trail ", "a  b", "a\n\nb", "a\u00a0b c", "\n", " ", "", "a \nb", "tab\there", "a\0b", "x\u3000y", "a\n b"])
def test_special_strings_and_odd_spaces(text):
    e = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    for t in (text, "warm up words, here. " + text, text + " word"):
        assert e.ids([t, t]) == [plain_ids(t, e.kind)] * 2


def test_unknown_words_are_learned_together():
    e = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    own, calls = e.library, []

    class Library:
        def __getattr__(self, name):
            return getattr(own, name)

        def encode_batch_fast(self, pieces, **kw):
            calls.append(sorted(pieces))
            return own.encode_batch_fast(pieces, **kw)

    e.library = Library()
    texts = ["Über*** alles*** so", "one*** don't two,.", "naïve &&& 日本語!? x_ _y a-b Ā", "end<|endoftext|>", ""]
    assert e.ids(texts) == [plain_ids(t, e.kind) for t in texts]
    # one call; the marks that end words are a piece of their own, told once
    assert [c for c in calls if c] == [sorted([" don't", "***", ",.", " &&&", "!?", "_", " _y", " a-b"])]
    e.between = None
    e.known = e._start()
    assert e.ids(texts) == [plain_ids(t, e.kind) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aZéĀ日.'*_<1", max_size=6), max_size=90))
def test_runs_of_marks_and_joined_words(words):
    if "marks" not in _ENCODER:
        _ENCODER["marks"] = tokens.Encoder(tokenizer_file("byte_bpe_50k.json"))
    e, text = _ENCODER["marks"], " ".join(words)
    assert e.ids([text, "b " + text]) == [plain_ids(t, e.kind) for t in (text, "b " + text)]


def test_token_files(spark, tmp_path):
    rows = odd_texts(random.Random(2)) + [(7, "again", "x"), (None, "no id", "x"), (90, "ends <|endoftext|> here", "x"), (91, "long words " * 300_000, "x")]
    path = tokenizer_file("byte_bpe_50k.json")
    tokens.write_tokens(spark.createDataFrame(rows, DOCS), str(tmp_path / "t"), path, end_id=0)
    got = sorted(tokens.read_tokens(spark, str(tmp_path / "t"), path, end_id=0).collect(), key=lambda r: r["start"])
    e = tokens.Encoder(path)
    want = {}
    for i, t, _ in rows:
        raw = plain_ids(t or "", e.kind) + np.array([0], "<u4").tobytes()
        want.setdefault(i, []).append((len(raw) // 4, zlib.crc32(raw)))
    at = 0
    for r in got:
        assert r["start"] == at and (r["n_tokens"], r["ids_crc32"]) in want[r["doc_id"]]
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in got]
    assert len(got) == len(rows) and ids[0] is None and ids[1:] == sorted(ids[1:])
    tokens.write_tokens(spark.createDataFrame([], DOCS), str(tmp_path / "e"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "e"), path).count() == 0


# html -------------------------------------------------------------------------

PAGE = """<html><head><title>no</title><style>p{}</style></head><body class=has-sidebar><header><h1>Site</h1></header>
<nav><ul><li><a href=/>menu</a></ul></nav><div class="cookie-notice">accept &amp; go</div>
<main><article class="post"><h1>Title &amp;\n  more</h1><p>First <b>bold<br>line</b><p>Second &eacute;&#33; a &lt; b
<script>if (1<2) {"</p>"}</script><form><input>mail</form><ul><li>one<li>two</ul><div class="ad">buy</div>
<!-- <p>hidden</p> --><section id="comments"><p>first!</p></section><article><p>me too</p></article></article></main>
<aside>related</aside><footer>&copy;</footer></body></html>"""


def test_html_blocks():
    page = html.Page(PAGE)
    assert html.main_text(page) == "Title & more\n\nFirst bold line\n\nSecond é! a < b\n\none\n\ntwo"
    assert html.main_text(html.Page("")) == "" and html.main_text(html.Page("plain <b>text")) == "plain text"
    assert html.main_text(html.Page("<p>a</p><p>b <a href='x")) == "a\n\nb"
    assert html.main_text(html.Page("<body>" + "<div>" * 500 + "deep" + "<p class='x")) == "deep"


def test_html_names_do_not_remove_the_main_text():
    read_ = lambda h: html.main_text(html.Page(h))
    article = "<article><p>the article</p><section id='related-work'><p>its section</p></section></article>"
    for name in ("content-sidebar-wrap", "site has-sidebar", "social-policy", "sidebar", "overflow-hidden"):
        assert read_(f"<body><div class='{name}'>{article}<div class='ad'>buy</div></div></body>") == "the article\n\nits section"
    # a named part stays out however long it is
    words = "word " * 60
    assert read_(f"<body><div class='notice'><p>{words}</p></div><div class='cookie-notice'>ok</div></body>") == ""
    assert read_(f"<body><article><p>the article</p><div class='ad'>{words}</div></article></body>") == "the article"
    assert read_(f"<body><div id=content><p>the article</p></div><div class='cookie-notice'>{words}</div></body>") == "the article"
    assert read_(f"<body><p>the article</p><div class='sidebar'>{words}</div></body>") == "the article"
    assert read_(f"<body><div class='overlay'><div role='main'><p>the article</p></div></div><div class='ad'>{words}</div></body>") == "the article"
    assert read_("<body><article>" + "<p>one</p>" * 20_000 + "</article></body>") == "\n\n".join(["one"] * 20_000)
    assert read_("<body><article><p>short</p></article><div id='comments'><article><p>" + "long " * 30 + "</p></article></div></body>") == "short"
    assert read_("<body><article><p>a</p><svg width='1' /><p>b</p><svg><text>no</text></svg><p>c <span class='ad'>buy</span>d</p></article></body>") == "a\n\nb\n\nc d"


def test_host_outvotes_a_misleading_page(spark):
    good = "<body><div class=text{}><p>{}</p></div><div class=box><p>short</p></div></body>"
    rows = [(i, "http://h.org/x", good.format(i, "words " * 40)) for i in range(12)]
    rows += [(99, "http://user@H.org:80/y", "<body><div class=text3><p>brief</p></div><div class=box><p>" + "long " * 90 + "</p></div></body>")]
    rows += [(98, None, "<body><p>alone</p></body>"), (97, "x", None), (97, "x", "")]
    got = {}
    for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    assert got[99] == ["brief"] and got[98] == ["alone"] and got[97] == ["", ""] and got[0] == [("words " * 40).strip()]
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# pieces -----------------------------------------------------------------------


def all_segmentations(v, seg):
    """Every path of the lattice: (score, ids), best first."""
    out = []

    def walk(i, score, ids):
        if i == len(seg):
            return out.append((score, ids))
        single = False
        for j in range(i + 1, len(seg) + 1):
            p = v.pieces.get(seg[i:j])
            if p is not None:
                single |= j == i + 1
                walk(j, score + v.score[p], [*ids, p])
        if not single:
            walk(i + 1, score + v.penalty, ids + v.ids_of(seg[i]))

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_pieces_against_all_segmentations():
    v = pieces.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    for text in ("the thing", "aaa bb", "a\nb", "Ωx é", "q"):
        ids, scores, alts = pieces.encode_texts(v, [text], 4)
        norm = v.model.normalize(text)
        want = all_segmentations(v, norm)
        assert scores[0] == want[0][0] and sum(v.score[p] if p not in v.byte.values() else 0 for p in ids[0]) >= want[0][0]
        assert [a["score"] for a in alts[0]] == [s for s, _ in want[1:4]]
        for a in alts[0]:
            edited, shift = list(ids[0]), 0
            for e in sorted(a["edits"], key=lambda e: e["at"]):
                edited[e["at"] + shift : e["at"] + shift + e["drop"]] = e["ids"]
                shift += len(e["ids"]) - e["drop"]
            assert (a["score"], edited) in [(s, [int(x) for x in p]) for s, p in want]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab Zé,\n　😀t", max_size=80))
def test_pieces_round_trip(text):
    v = pieces.vocabulary(tokenizer_file("piece_bpe_32k.model"))
    ids, _, _ = pieces.encode_texts(v, [text], 2)
    assert pieces.decode_ids(v, ids[0], np.array([0, len(ids[0])])) == [text]


def test_pieces_in_one_pass(spark):
    model = tokenizer_file("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a small text", "x"), (2, None, "y"), (3, "", "z"), (4, "é " * 900, "x")], DOCS)
    for d in (docs, docs.withColumnRenamed("extra", "score"), docs.limit(0)):
        two = pieces.decode(pieces.encode(d, model).drop("text"), model)
        one = pieces.round_trip(d, model)
        assert one.schema == two.schema
        assert sorted(one.collect()) == sorted(two.collect())


def test_pieces_query_shape(spark):
    rows = odd_texts(random.Random(3)) + [(None, "no id", "x"), (1, "again", "x"), (50, "w" * 300 + " end", "x")]
    model = tokenizer_file("piece_bpe_32k.model")
    out = pieces.decode(pieces.encode(spark.createDataFrame(rows, DOCS), model, n_best=3), model).collect()
    assert len(out) == len(rows) and all((r["text"] or "") == r["decoded"] and r["extra"] for r in out)
    assert pieces.encode(spark.createDataFrame([], DOCS), model).count() == 0


# tiling -----------------------------------------------------------------------


def test_tiles_mark_reordered_parts():
    a = np.arange(1, 41, dtype=np.uint64)
    moved = np.concatenate([a[25:], [99], a[:12], [98], a[12:25]]).astype(np.uint64)
    assert sum(n for _, _, n in tiling.tiles(a, moved)) == 40
    assert tiling.tiles(a, a[:4]) == [] and tiling.tiles(a, np.zeros(0, np.uint64)) == []
    same = np.full(30, 7, np.uint64)
    assert sum(n for _, _, n in tiling.tiles(same, same[:17])) == 17


def test_decontamination(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    item = [word() for _ in range(30)]
    other = [word() for _ in range(300)]
    half = item[:15]
    docs = [
        (1, " ".join(other), "x"), (2, " ".join(other[:50] + item + other[50:]), "x"),
        (3, " ".join(other[:9] + item[16:] + other[9:20] + item[:16]).upper().replace(" ", ", "), "x"),
        (4, " ".join(other[:40] + half), "x"), (5, None, "x"), (6, "", "x"), (None, " ".join(item), "x"), (2, "clean row", "x"),
    ]
    df = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([(10, " ".join(item)), (11, "too few words"), (12, None), (10, " ".join(item))], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["kept"], r["item_ids"]) for r in tiling.judged(df, bench).collect()), key=str)
    assert got == sorted([(1, True, []), (2, False, [10]), (2, False, [10]), (3, False, [10]), (4, True, []), (5, True, []), (6, True, []), (0, True, [])], key=str)
    assert {r["doc_id"] for r in tiling.decontaminate(df, bench).collect()} == {1, 4, 5, 6, None}
    assert tiling.judged(df, bench.limit(0)).where("kept").count() == len(docs) and tiling.judged(df.limit(0), bench).count() == 0


def test_decontamination_of_short_unspaced_and_curly_items(spark):
    cjk = "\u4eca\u5929\u7684\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed"
    bench = [(1, "What is two?"), (2, cjk), (3, "He said \u2018the quick brown fox\u2019 \u2014 and left us all"), (4, "\u2026 !"), (5, None)]
    docs = [
        (1, "so, what IS \u201ctwo\u201d then", "x"), (2, "what two is", "x"), (3, "\u5c31\u662f" + cjk + "\u5427", "x"), (4, cjk[:5], "x"),
        (5, "then he said: the quick\u00a0brown fox \u2013 and left us all.", "x"), (None, "what is two", "x"), (6, "what is", "x"), (7, "two? what is two", "x"),
    ]
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = {r["doc_id"]: r["item_ids"] for r in tiling.judged(spark.createDataFrame(docs, DOCS), items).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [], 5: [3], None: [], 6: [], 7: [1]}


# substrings -------------------------------------------------------------------


def removed_by_definition(rows, window):
    first = {}
    for i, t, _ in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t, _ in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 10, 50])
def test_substrings_by_definition(spark, window):
    rng = random.Random(window)
    passage = " ".join(f"w{rng.randrange(40)}" for _ in range(70))
    rows = odd_texts(rng) + [(100 + i, f"s{i} " * rng.randrange(30) + passage + f" t{i % 3}" * rng.randrange(40), "x") for i in range(12)]
    rows += [(None, passage, "x"), (103, passage, "x"), (60, "r " * 130, "x"), (61, "r " * 90, "x")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), window, join_all=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out), key=str) == removed_by_definition(rows, window)
    assert substrings.remove_repeats(spark.createDataFrame([], DOCS), window).count() == 0


def test_long_copies_in_chains_out_of_step(spark):
    rng = random.Random(5)
    body = [f"w{rng.randrange(3000)}" for _ in range(9000)]
    rows = [(10, " ".join(body), "x"), (11, " ".join(body[37:]), "x"), (12, " ".join(body[:4000] + ["new"] + body[4000:]), "x")]
    rows += [(9, " ".join(body[2000:2400]), "x"), (13, " ".join(body[5000:] + body[:100]), "x")]
    out = substrings.remove_repeats(spark.createDataFrame(rows, DOCS), 10, join_all=True).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["text"]) for r in out), key=str) == removed_by_definition(rows, 10)


def test_chains_break_at_gaps_cuts_and_their_greatest_length():
    n = substrings.CHAIN_MOST * 2 + 5
    row, place, none = np.zeros(n, int), np.arange(n), np.zeros(n, bool)
    odd = np.full(n, 1, np.uint64)
    assert substrings.chains_of(row, place, odd, none).tolist() == [0, substrings.CHAIN_MOST, 2 * substrings.CHAIN_MOST]
    cell = odd.copy()
    cell[3] = substrings.CHAIN_CUT
    single = none.copy()
    single[8] = True
    place = place + (np.arange(n) >= 6)
    row = row + (np.arange(n) >= 11)
    assert substrings.chains_of(row, place, cell, single)[:6].tolist() == [0, 4, 6, 8, 9, 11]


def test_shared_table_keeps_rows(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS a")
    assert shared_table(df, "t").count() == 10
