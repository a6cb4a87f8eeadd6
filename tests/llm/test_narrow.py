"""Operators 1, 2, 4, 5, 8 and 9: hard rows, empty tables and brute force."""

import hashlib
import re
import zlib

import pytest

from quernstone.llm import op01_quality_divergence as o1
from quernstone.llm import op02_toxicity as o2
from quernstone.llm import op04_html as o4
from quernstone.llm import op05_secrets as o5
from quernstone.llm import op08_token_counts as o8
from quernstone.llm import op09_licenses as o9
from tests_llm_helpers import counts_by_hand, tokenizer  # noqa: F401

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 1 ------------------------------------------------------------------------------
def test_op1_counts(hard, small):
    for docs in (hard, small["documents"]):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in o1.quality(docs).collect()), key=str)
        assert got == sorted(((i, *counts_by_hand(t or "")) for i, t in texts), key=str)


def test_op1_verdicts(small, none):
    rows = o1.quality(small["documents"]).join(small["labels"], "doc_id").filter("not base_failed").collect()
    good, junk = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) / len(good) > 0.95
    assert not junk or sum(junk) / len(junk) < 0.4
    assert o1.quality(none).count() == 0


def test_op1_needs_a_reference(spark):
    """A language with few words has no reference of its own: its junk is held against the nearest."""
    import random

    words = "the house of the old man was on the hill and we have seen it from the road that is by the river, as it was in the time of our fathers.".split()
    good = lambda k: " ".join(random.Random(k).choices(words, k=90))
    rows = [(i, good(i), "en") for i in range(60)] + [(100, " ".join(f"zx{k}q#kv" for k in range(150)), "de"), (101, good(101), "xx"), (102, good(102), None), (None, good(103), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in o1.quality(docs).collect()}
    assert got[100] == (False, False) and all(got[i] == (False, True) for i in (0, 59, 101, 102, None))
    assert o1.quality(docs.filter("lang = 'de'")).filter("kept").count() == 2  # without any reference only the base rules decide


# ---- 2 ------------------------------------------------------------------------------
def test_op2_held_out(small, hard, none):
    docs, labels = small["documents"], small["labels"]
    rows = o2.toxicity(docs, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert o2.toxicity(hard, labels).count() == hard.count()
    assert o2.toxicity(none, labels).count() == 0
    assert o2.toxicity(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_op2_learns():
    words = ["good", "nice", "calm", "river"]
    texts = [(f"{words[i % 4]} {words[i // 4 % 4]} {'you scumbag' if i % 5 == 0 else 'you friend'} {i}", int(i % 5 == 0)) for i in range(300)]
    w = o2.fit([o2.ngrams(t) for t, _ in texts], [y for _, y in texts], 0.2)
    score = o2.Scorer(w)
    assert score("what a scumbag you are") > 0.5 > score("what a friend you are")
    assert abs(score(None) - score("")) < 1e-12
    long_text = "nice calm river " * 3000
    assert score(long_text) < 0.5


def test_op2_grams_round_trip():
    import numpy as np

    for t in ("", "a", "some text of words", "é" * 500):
        assert (o2.decode(o2.encode(o2.ngrams(t))) == o2.ngrams(t)).all()
    far = np.array([0, 5, (1 << o2.BITS) - 1], np.int32)
    assert (o2.decode(o2.encode(far)) == far).all()


def test_op2_scorer_like_dense_weights():
    import numpy as np

    rng = np.random.default_rng(0)
    at = np.arange(0, 2 * o2.SIZE, 3)
    w = o2.Weights(at, rng.normal(size=len(at)).astype(np.float32) / 100, -0.1)
    every = np.zeros(2 * o2.SIZE)
    every[at] = w.value
    score = o2.Scorer(w)
    for t in (None, "", "a", "abc", "repeat repeat repeat repeat", "Ünïcode", "once only " + "x" * 2000 + " and again only once"):
        z = w.bias + float(every[o2.ngrams(t)].sum())
        assert score(t) == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_op2_dense_grade():
    once, twice = o2.ngrams("alpha beta gamma"), o2.ngrams("alpha beta alpha")
    assert (once < o2.SIZE).all() and (twice >= o2.SIZE).any()
    far = "alpha " + "zyxw " * 1000 + "alpha"
    lone = set(o2.ngrams("alpha").tolist()) - set(o2.ngrams("zyxw " * 5).tolist())
    assert not any(g + o2.SIZE in o2.ngrams(far).tolist() for g in lone)


# ---- 4 ------------------------------------------------------------------------------
PAGES = [
    (1, "u", None), (2, "u", ""), (3, None, "plain text only, no markup"),
    (4, "u", "<html><body><nav><a href=x>Home</a></nav><article><h1>T &amp; U</h1><p>One<br>two &lt;b&gt;</p><p>Three</article><footer>f</footer></body></html>"),
    (5, "u", "<article><p>a <b>bold<p>next &#233;&nbsp;x</p><div class='ad'>buy</div><script>if (a<b) x('</p>')</script><p>last</p></article>"),
    (6, "u", "<article><p>kept</p><section id=comments><article class=comment><p>dropped</p></article></section><form><p>dropped</p></form><aside><p>dropped</p></aside></article>"),
]


def test_op4_pages(spark, small):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r["page_id"]: r for r in o4.extract(df).collect()}
    assert [got[i]["text"] for i in (1, 2, 4, 5, 6)] == ["", "", "T & U\n\nOne two <b>\n\nThree", "a bold\n\nnext é x\n\nlast", "kept"]
    assert got[3]["url"] is None and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert o4.extract(df.limit(0)).count() == 0


def test_op4_whole_article(small):
    import html

    for r in small["pages"].collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", p)).replace("<b>", "").split()) if "&" not in p else " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert o4.extract_text(r["html"]) == "\n\n".join(re.sub(r"<[^>]*>", "", p) if "&" not in p else p for p in parts if p)


def test_op4_rules_without_article():
    para = "It is one of the things that we have to do with all of them, and it was not for this or that, but as it is in the end for all who were there at the time. " * 2
    page = f"<body><div class=menu><a href=1>a</a></div><div><p>{para}</p><p>Short.</p><p>{para}</p></div><div><a href=1>one link after</a> <a href=2>another link of many</a></div></body>"
    assert o4.extract_text(page) == "\n\n".join([" ".join(para.split()), "Short.", " ".join(para.split())])


def test_op4_rules_with_article():
    """Named articles are a prior: text outside of them can be good, link lists inside of them bad."""
    para = " ".join(("It is one of the things that we have to do with all of them, and it was not for this or that, but as it is in the end for all who were there at the time. " * 2).split())
    links = "<ul>" + "".join(f"<li><a href={i}>another page of this kind {i}</a> more</li>" for i in range(3)) + "</ul>"
    page = f"<body><div class=menu><a href=1>a</a></div><div><p>{para}</p><p>Short.</p><p>{para}</p></div><div>{links}</div><article><a href=2>Teaser of another page</a></article></body>"
    assert o4.extract_text(page) == "\n\n".join([para, "Short.", para])
    between = "<p><a href=5>another page of this kind</a></p><p><a href=6>see also this one</a> and more words</p><p><a href=7>and one that is like it</a></p>"
    assert o4.extract_text(f"<article><p>{para}</p>{between}<p>{para}</p></article>") == "\n\n".join([para, para])
    # what is poor in stop words stays in an article, next to adverts and with prose elsewhere
    page = f"<nav>x</nav><article><p>Zyx wvu.</p><div class=ad>buy</div><p>{'Zyx wvu tsr. ' * 30}</p><div class=ad>buy</div><p>Qpo nml.</p></article><footer>f</footer><div><p>{para}</p></div>"
    assert o4.extract_text(page) == "\n\n".join(["Zyx wvu.", ("Zyx wvu tsr. " * 30).strip(), "Qpo nml.", para])


def test_op4_without_article_tags(small):
    """The rules alone, on pages whose article isn't named: precision and recall by block."""
    import collections

    hit = said = there = 0
    for r in small["pages"].collect():
        want = collections.Counter(filter(None, o4.extract_text(r["html"]).split("\n\n")))
        got = collections.Counter(filter(None, o4.extract_text(re.sub(r"<(/?)(?:article|main)\b[^>]*>", r"<\1div>", r["html"])).split("\n\n")))
        hit, said, there = hit + sum((want & got).values()), said + sum(got.values()), there + sum(want.values())
    assert hit / said >= 0.98 and hit / there >= 0.85


def test_op4_time_in_proportion():
    """Pages without end tags, deep nests and unclosed quotes take no time that grows with the square."""
    import time

    for part in ("<p>abc", "<ul><li>a", "<div><b>", '<a href="x', "<!--", "<script>", "&amp", "</i>x"):
        began = time.perf_counter()
        o4.extract_text(part * 30_000)
        assert time.perf_counter() - began < 10, part


def test_op4_hard_rows(spark):
    article = "<article>" + "".join(f"<p>It is one of the things {k} that we have to do with all of them.</p>" for k in range(20_000)) + "</article>"
    rows = [(None, None, article), (1, "u", article), (1, "u", article), (2, "u", "<" * 3000), (3, "u", "<div>" * 3000 + "deep" + "</div>" * 10), (4, "u", "&#xD800; &bogus; &amp;lt;<p>\x00")]
    got = o4.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS words")).collect()
    assert len(got) == 6 and [r["n_chars"] for r in got if r["page_id"] in (None, 1)] == [len(o4.extract_text(article))] * 3 and len(o4.extract_text(article)) > 1_000_000


# ---- 5 ------------------------------------------------------------------------------
def spans_by_hand(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out))


SECRETS = [
    (1, None), (2, ""), (3, 'PassWord = "short1" token:\'longenough1\' API_KEY=abcdefgh'), (4, "é😀 AKIA" + "A1" * 8 + " " + "0f" * 20 + " " + "0f" * 15), (5, "secret=secret=secret=12345678 " * 50),
    (6, "my key ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6" + " and thousands of ordinaryfarstretchedwordswithoutend"), (7, "toKen : " + "x" * 7 + " token: " + "x" * 8),
]


def test_op5_base(spark, small):
    df = spark.createDataFrame(SECRETS, "doc_id long, text string").unionByName(small["documents"].select("doc_id", "text")).selectExpr("*", "1 AS spans")
    texts = {r["doc_id"]: r["text"] for r in small["documents"].collect()} | {}
    for r in o5.scan(spark.createDataFrame(SECRETS, "doc_id long, text string")).collect():
        own = spans_by_hand(dict(SECRETS)[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest()
        assert set(filter(None, own.split(","))) <= set(r["spans"].split(","))
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(own.count(f"{k}:") for k in ("assign", "access", "hex"))
    for r in o5.scan(small["documents"]).collect():
        assert r["base_sha256"] == hashlib.sha256(spans_by_hand(texts[r["doc_id"]] or "").encode()).hexdigest()
    assert o5.scan(df.limit(0)).count() == 0


def test_op5_automata():
    m = o5.default_model()
    for family in o5.FORMATS:
        held = o5.labelled(family, 100, 77)
        assert sum(m.score(s) is not None for s in held) >= 85, family
        assert len(m.parts[family][0].table) < 60
    for s in ("thisisaratherlongwordofprose", "2024-01-01T00:00:00.000000", "src/main/java/com/example/File.java", "AIza", "x" * 40):
        assert m.score(s) is None
    assert [k for _, k, _ in o5.find_spans(SECRETS[5][1])[1]] == ["auto_github"]


def test_op5_redacts(hard, spark):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in SECRETS], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in o5.redact(df).collect()}
    assert out[1]["text"] is None and out[4]["text"].count("[SECRET]") == 2 and "ghp_" not in out[6]["text"]
    assert all(spans_by_hand(r["text"] or "") == "" for r in out.values())
    assert out[6]["n_chars"] == len(out[6]["text"])
    assert o5.redact(hard).columns == hard.columns and o5.redact(hard).count() == hard.count()


def test_op5_glued():
    """Credentials that are part of a longer run: after a name, in an address, before other text, in a long blob."""
    for family in o5.FORMATS:
        for k, key in enumerate(s for s in o5.labelled(family, 12, 78) if o5.default_model().score(s)):
            for before, after in (("STRIPE_KEY=", ""), ("https://host/a/", "/x.git"), ("https://h.example/q?a=b/key=", "="), ("x+", "+y"), ("0/" * 400, "/" + "+0" * 400)):
                text = f"see {before}{key}{after} there"
                start = 4 + len(before)
                base, more = o5.find_spans(text)
                spans = [(s, e) for s, _, e in base + more]
                assert any(s <= start and start + len(key) <= e for s, e in spans), (family, k, before)
                assert key not in o5.redact_text(text)


def test_op5_added_spans_like_brute_force():
    """Every part of every run scored by itself: the longest from each place, without those inside of others."""
    import random

    rng, m = random.Random(6), o5.default_model()
    texts = [f"{rng.choice(['GH_PAT=', 'export K=', 'https://h/', '(', 'x+'])}{rng.choice(o5.labelled(f, 4, 31))}{rng.choice(['', '/x.git', '=', ')', '&b=c'])} and_more-words/of=prose+here" for f in o5.FORMATS for _ in range(3)]
    for text in texts:
        want = []
        for run in o5.RUN.finditer(text):
            s, found = run.group(), []
            for family, (a, limit, least) in m.parts.items():
                for at in range(len(s)):
                    ends = [e for e in range(at + least, len(s) + 1) if a.bits(s[at:e]) >= limit - 1e-12]
                    solid = [e for e in ends if s[e - 1] not in ".=-"] or ends
                    if solid:
                        found.append((at, -solid[-1], limit - a.bits(s[at : solid[-1]]), family))
            covered = 0
            for start, end, _, family in sorted(found):
                if -end > covered:
                    covered = -end
                    want.append((run.start() + start, f"auto_{family}", run.start() + covered))
        base, more = o5.find_spans(text)
        want = [w for w in want if not any(b <= w[0] and w[2] <= e for b, _, e in base)]
        assert [(s, e) for s, _, e in more] == [(s, e) for s, _, e in want], text


def test_op5_hard_rows(spark, hard, none):
    key = "GH_PAT=ghp_" + "aB3dE6gH9jK2mN5pQ8sT1vW4yZ7bC0eF3hJ6"
    rows = [(None, key), (1, key), (1, key), (2, ("z" * 999 + " ") * 500 + key), (3, "x" * 300_000)]
    got = o5.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS spans", "1 AS n_hex")).collect()
    assert sorted((str(r["doc_id"]), "auto_github" in r["spans"]) for r in got) == [("1", True), ("1", True), ("2", True), ("3", False), ("None", True)]
    assert o5.scan(hard).count() == hard.count() and o5.scan(none).count() == 0 and o5.redact(none).count() == 0


def test_op5_long_runs_as_short(monkeypatch):
    import random

    rng, m = random.Random(5), o5.default_model()
    runs = ["".join(rng.choice(["/", "=", "-", "_", "aB3", "AIza", "ghp_", "AKIA", rng.choice(o5.labelled(f, 3, 9))]) for _ in range(12)) for f in o5.FORMATS for _ in range(6)]
    short = [m.parts_of(s) for s in runs]
    monkeypatch.setattr(o5, "LONG_RUN", 0)
    assert [m.parts_of(s) for s in runs] == short and sum(map(len, short)) > 40


# ---- 8 ------------------------------------------------------------------------------
def test_op8_counts(hard, small, none, tokenizer):
    for docs in (hard, small["documents"]):
        texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
        want = sorted(((i, len((t or "").encode()), len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for i, t in texts), key=str)
        rows = o8.token_counts(docs).collect()
        assert sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows), key=str) == want
        assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in rows)
    assert o8.token_counts(none).count() == 0


def test_op8_any_chunks(tokenizer):
    import random

    rng, count = random.Random(3), o8.counter("byte_bpe_50k.tiktoken")
    alphabet = [*"ab c  \n\té'sdRE12#$…　\xa0\x85\x1c日本​", "<|endoftext|>", "'ll", " the", "  ", "\r\n", "​"]
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        want = len(tokenizer.encode(s, add_special_tokens=False).ids)
        assert [count(s, chunk) for chunk in (1 << 20, 11, 3, 1)] == [want] * 4


def test_op8_chunk_maps_compose():
    """Maps may be combined in any order; the end state of one is the state the next begins in."""
    import random

    rng, count = random.Random(8), o8.counter("byte_bpe_50k.tiktoken")
    for _ in range(100):
        s = "".join(rng.choice([*"ab 'sl1!\n", "  ", "don't", " they're", "'", "'r", " x", "é日"]) for _ in range(rng.randint(1, 40)))
        maps = [count.chunk_map(s[i : i + 3]) for i in range(0, len(s), 3)]
        left, right = maps[0], maps[-1]
        for m in maps[1:]:
            left = count.compose(left, m)
        for m in maps[-2::-1]:
            right = count.compose(m, right)
        assert count.scan([left]) == count.scan([right]) == count.scan(maps) == count(s)


def test_op8_one_path_for_all_lengths(tokenizer, monkeypatch):
    """Texts of every length are counted by chunk maps; a text without any cut is one open head."""
    seen = []
    count = o8.counter("byte_bpe_50k.tiktoken")
    real = o8.Counter.chunk_map
    monkeypatch.setattr(o8.Counter, "chunk_map", lambda self, chunk: seen.append(len(chunk)) or real(self, chunk))
    for s in ("a", "some words of text", "x" * 10_000, "word's " * 3000, " \n" * 5000, "it'll be'r " * 500 + "'"):
        seen.clear()
        assert count(s) == len(tokenizer.encode(s, add_special_tokens=False).ids) and len(seen) == -(-len(s) // o8.CHUNK)


# ---- 9 ------------------------------------------------------------------------------
LICENCES = [
    (1, None), (2, ""), (3, "Nothing here.\nLicensed under the Apache License, Version 2.0.\nMore."), (4, "Released under the MIT License."), (5, "the driving licence of my sister\npermission to land was given"),
    (6, "This work is licensed under the GNU General Public License, version 3.\n" * 2), (7, "x " * 60_000 + "\nLicensed under CC BY-NC 4.0."),
]


def notices_by_hand(text):
    m, lines, found = o9.model(), (text or "").split("\n"), []
    for i in range(len(lines)):
        for n in range(1, o9.MOST_LINES + 1):
            if i + n > len(lines) or any(not x.strip() for x in lines[i + 1 : i + n]):
                break
            paragraph = " ".join(lines[i : i + n])
            family, p = m.predict(paragraph)
            own = lambda x: bool(set(o9.py_tokens(x)) & ({w for g in m.number for w in g.split()} - o9._STOP))
            if family != o9.UNKNOWN and p >= o9.LEAST_PROBABILITY and own(lines[i]) and own(lines[i + n - 1]):
                found.append((i, n, family, m.share(paragraph, family) >= o9.LEAST_TEMPLATE))
    return [w for w in found if not any(o[1] < w[1] and o[0] >= w[0] and o[0] + o[1] <= w[0] + w[1] for o in found)]


def notices(docs):
    return sorted(((r["doc_id"], r["paragraph"], r["n_lines"], r["family"], r["confirmed"]) for r in o9.scan(docs).collect()), key=str)


def test_op9_families(spark, small, none, hard):
    df = spark.createDataFrame(LICENCES, "doc_id long, text string").selectExpr("*", "1 AS line", "2 AS paragraph", "3 AS lines", "4 AS found")
    assert notices(df) == [(3, 1, 1, "apache-2.0", True), (4, 0, 1, "mit", True), (6, 0, 1, "gpl", True), (6, 1, 1, "gpl", True), (7, 1, 1, "cc-by-nc", True)]
    assert o9.scan(none).count() == 0 and o9.scan(hard).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License."), (4, "Released under the MIT License."), (4, "Released under the MIT License.")], "doc_id long, text string")
    assert notices(twice) == [(4, 0, 1, "mit", True)] * 2 + [(None, 0, 1, "mit", True)]


def test_op9_same_as_python(spark, small):
    import random

    rng = random.Random(4)
    assert o9.model().held_out_accuracy > 0.95
    lines = ["released  UNDER--the (MIT) license.", "an MIT.", "of the and", "", " "]
    words = sorted({w for ts in o9.TEMPLATES.values() for t in ts for w in t.split()})
    for ts in o9.TEMPLATES.values():
        for t in ts:
            w = t.split()
            lines += [" ".join(w[i : i + n]) for n in (2, 4, 7) for i in range(len(w) - n + 1)]
    lines += [" ".join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(300)]
    rng.shuffle(lines)
    made = spark.createDataFrame([(1_000_000 + k, "\n".join(lines[k : k + 40])) for k in range(0, len(lines), 40)], "doc_id long, text string")
    docs = small["documents"].select("doc_id", "text").unionByName(made)
    want = sorted(((r["doc_id"], *w) for r in docs.collect() for w in notices_by_hand(r["text"])), key=str)
    assert notices(docs) == want and len(want) > 60


def test_op9_wrapped(spark):
    texts = [
        "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of it was not given",
        "one\nReleased under the\nMIT\nLicense\nand more",
        "This work is licensed under a\nCreative Commons Attribution 4.0\nInternational License",
        "Released under the\n\nMIT License",
    ]
    got = notices(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [(i, f) for i, _, _, f, c in got if c] == [(0, "mpl-2.0"), (1, "mit"), (2, "cc-by"), (3, "mit")]
    assert {(i, k, n) for i, k, n, _, _ in got if i == 3} == {(3, 2, 1)}  # a blank line ends a paragraph


def test_op9_many_notices_in_a_text(spark):
    """A text of notices only: each line once, in time that grows with the lines."""
    text = "\n".join(["Released under the MIT License.", "plain words"] * 3000)
    got = notices(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert got == sorted(((1, k, 1, "mit", True) for k in range(0, 6000, 2)), key=str)


def test_op9_other_licences_are_unknown(spark):
    """Licences that no template names are of the unknown class, in the forms that notices of known ones have."""
    names = "EUPL-1.2 Zlib BSL-1.0 EPL-2.0 OFL-1.1 WTFPL PostgreSQL Artistic-2.0 CDDL-1.0 Python-2.0 ECL-2.0 MulanPSL-2.0 Eclipse".split()
    forms = ["SPDX-License-Identifier: {}", "Licensed under the {} License", "Released under the {} license", "This project is licensed under the terms of the {} license", "Distributed under the {} License, version 2.0", "{} Public License v2.0", "You may use this under the {} terms"]
    rows = [(k, f.format(n)) for k, (n, f) in enumerate((n, f) for n in names for f in forms)]
    got = o9.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert not any(r["confirmed"] for r in got) and len(got) <= len(rows) // 50
    known = [(k, f, t) for k, (f, t) in enumerate((f, t) for f, ts in o9.TEMPLATES.items() for t in ts)]
    assert [(r["doc_id"], r["family"]) for r in sorted(o9.scan(spark.createDataFrame([(k, t) for k, _, t in known], "doc_id long, text string")).collect()) if r["confirmed"]] == [(k, f) for k, f, _ in known]
