"""License scans, token counts, HTML extraction and language ID."""

import base64
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlattice.llm import html_main as H, language as L, licenses as N, token_counts as C
from textlattice.llm.queries import TOKENIZERS

# ---- licenses


def places(text):
    w = [x.decode() for x in N.tokens(text or "")]
    found = [(i, label) for p, label in N.PHRASES.items() for q in [p.split()] for i in range(len(w) - len(q) + 1) if w[i : i + len(q)] == q]
    return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), sorted({x for _, x in found})


def test_license_places(make):
    rnd = random.Random(1)
    vocab = "gnu general public license apache mit cc by the x.y CC-BY GNU and é".split()
    rows = [(k, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.randint(0, 60)))) for k in range(80)]
    rows += [(90, None), (91, ""), (92, "MIT License"), (92, "MIT License"), (93, "word " * 30_000 + "apache license"), (94, "mit" + "\0" + "license")]
    out = [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in N.license_scan(make(rows)).collect()]
    assert sorted(out, key=repr) == sorted(((i, places(t)) for i, t in rows), key=repr)
    assert N.license_scan(make([])).collect() == []


def test_license_templates(make):
    isc, bsd = dict(N.TEMPLATES)["isc"], dict(N.TEMPLATES)["bsd"]
    half = " ".join(isc.split()[:9])
    rows = [(1, "intro " + isc + " outro"), (2, half), (3, bsd.replace("provided", "XXX provided", 1)), (4, "software and the use of it")]
    out = {r.doc_id: r for r in N.license_scan(make(rows)).collect()}
    assert out[1].labels == ["isc"] and out[1].score == 1.0 and out[1].spans[0].start == 1
    assert out[3].labels == ["bsd"] and len([s for s in out[3].spans if s.label == "bsd"]) == 1  # one chain over the gap
    assert out[4].labels == [] and out[4].n_base == 0


def slow_labels(text):
    """Labels, score and spans by comparing the words at every place with every template."""
    w, templates = [x.decode() for x in N.tokens(text)], [(label, [x.decode() for x in N.tokens(t)]) for label, t in N.TEMPLATES]
    runs = [t for _, t in templates] + [p.split() for p in N.PHRASES]
    holds = {tuple(r[i:j]) for r in runs for i in range(len(r)) for j in range(i + 1, min(len(r), i + 60) + 1)}
    longest = []
    for i in range(len(w)):
        n = longest[-1] + 1 if longest else 1
        while n and tuple(w[i + 1 - n : i + 1]) not in holds:
            n -= 1
        longest.append(n)
    spans = [(i + 1 - n, i + 1) for i, n in enumerate(longest) if n >= N.LONG and (i + 1 == len(w) or longest[i + 1] != n + 1)]
    chains, matches = [], []
    for k, (label, t) in enumerate(templates):
        run = None
        for a, b in spans:
            stands = [i for i in range(len(t) - (b - a) + 1) if t[i : i + b - a] == w[a:b]]
            if not stands:
                continue
            matches.append((a, b, label, k))
            new = max(a, run["end"]) if run else a
            if new >= b:
                continue
            on = [p + new - a for p in stands if run and p + new - a >= run["to"] and new - run["end"] <= N.GAP]
            at = min(on) if on else min(stands) + new - a
            if not on:
                run = {"start": new, "label": label, "from": at, "size": len(t), "n": 0, "k": k}
                chains.append(run)
            run |= {"end": b, "to": at + b - new, "n": run["n"] + b - new}
    labels = set()
    for c in chains:
        own = [(a, b) for a, b, label, k in matches if k == c["k"] and c["start"] <= a and b <= c["end"] and b - a >= N.ENOUGH and {x[2] for x in matches if x[:2] == (a, b)} == {label}]
        larger = [d for d in chains if d["label"] != c["label"] and d["start"] <= c["start"] and c["end"] <= d["end"] and d["n"] > c["n"]]
        if (own or c["n"] >= N.COVER * c["size"]) and not larger:
            labels.add(c["label"])
    base = places(text)[4]
    score = max([1.0 if base else 0.0, *(min(1.0, c["n"] / c["size"]) for c in chains)])
    return sorted(labels | set(base)), score, sorted((c["start"], c["end"], c["label"], c["from"], c["to"]) for c in chains)


def test_license_labels_equal_slow_version(make):
    rnd = random.Random(12)
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            words_ = rnd.choice(N.TEMPLATES)[1].split()
            a = rnd.randrange(len(words_))
            parts += words_[a : a + rnd.choice([3, 6, 12, 40, 200])] + ["filler"] * rnd.choice([0, 1, 5, 20])
        rows.append((i, " ".join(parts)))
    rows += [(100 + k, "Copyright me. " + t) for k, (_, t) in enumerate(N.TEMPLATES)]
    out = {r.doc_id: (r.labels, r.score, sorted((s.start, s.end, s.label, s.template_start, s.template_end) for s in r.spans)) for r in N.license_scan(make(rows)).collect()}
    for i, t in rows:
        labels, score, spans = slow_labels(t)
        assert out[i][0] == labels and abs(out[i][1] - score) < 1e-12 and out[i][2] == spans, (i, t)
    # a whole license has its own label, those of its phrases and no other
    assert all({label} <= set(out[100 + k][0]) <= {label, *places(t)[4]} for k, (label, t) in enumerate(N.TEMPLATES))


def test_passages_that_licenses_share(make):
    shared = "it is free software; you can redistribute it and/or modify it under the terms of the GNU"
    rows = [(1, shared + " Affero"), (2, shared), (3, "THE SOFTWARE IS PROVIDED AS IS WITHOUT WARRANTY OF ANY KIND")]
    out = {r.doc_id: (r.labels, {s.label for s in r.spans}) for r in N.license_scan(make(rows)).collect()}
    assert out[1] == (["agpl"], {"agpl"}) and out[2] == ([], {"gpl", "lgpl", "agpl"}) and out[3][0] == ["mit"]


def test_automaton_finds_longest_matches():
    rnd = random.Random(2)
    for _ in range(60):
        seqs = [[rnd.randrange(3) for _ in range(rnd.randint(1, 9))] for _ in range(3)]
        auto = N.Automaton(seqs[:2], seqs[2:])
        text = [rnd.randrange(4) for _ in range(25)]
        has = lambda s: any(q[k : k + len(s)] == s for q in seqs for k in range(len(q)))
        for i, (v, n) in enumerate(auto.stream(text)):
            assert n == max(k for k in range(i + 2) if has(text[i + 1 - k : i + 1]) or k == 0)
            phrase = seqs[2]
            assert (text[max(0, i + 1 - len(phrase)) : i + 1] == phrase) == any(size <= n for _, size in auto.phrase[v])


# ---- token counts


@pytest.fixture(scope="module")
def model():
    with open(f"{TOKENIZERS}/piece_bpe_32k.model", "rb") as f:
        return f.read()


def test_token_counts_equal_the_library(spark, model, make):
    sp = pytest.importorskip("sentencepiece")
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    p = pb.ModelProto()
    p.ParseFromString(model)
    p.trainer_spec.model_type = 1
    k = 0
    for piece in p.pieces:
        if piece.type == 1:
            piece.score = float(np.float32(-math.log(k + 2)))
            k += 1
    ref = sp.SentencePieceProcessor(model_proto=p.SerializeToString())
    rnd = random.Random(1)
    rows = [(k, "".join(rnd.choice("abcdeé 梦☃\n\t  thingion") for _ in range(rnd.randint(0, 400)))) for k in range(120)]
    rows += [(200, None), (201, ""), (202, " "), (203, "   "), (204, "a" * 20_000), (205, "the " * 20_000), (206, "\0"), (206, "\0"), (207, "▁x")]
    got = sorted(((r.doc_id, r.n_tokens) for r in C.token_counts(make(rows), model, ["doc_id"], rank_scores=True).collect()))
    assert got == sorted((i, len(ref.encode(t)) if t else 0) for i, t in rows)
    assert C.token_counts(make([]), model, ["doc_id"]).collect() == []


def test_slices_and_forgetting_change_nothing(model, monkeypatch):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["the ", "thing", " of", "  ", "é", "梦", "xq", "\n", "ing "]) for _ in range(rnd.randint(0, 3000))) for _ in range(30)] + ["", None, "a" * 9000, " " * 500]
    vocabulary = C.Vocabulary(model).by_rank()
    whole = C.Counter(vocabulary).counts(texts)
    monkeypatch.setattr(C, "SLICE", 700)
    monkeypatch.setattr(C, "REMEMBER", 50)
    assert C.Counter(vocabulary).counts(texts) == whole
    few = C.Counter(vocabulary)
    few.machine.code[ord("t")] = -1  # characters outside the tables are read one segment at a time
    assert few.counts(texts) == whole


# ---- HTML


def article(body, before="", after=""):
    return f"<html><head><title>T</title><script>var x='</p>';</script></head><body><nav><a href=/>Menu</a></nav>{before}<article><h1>Head</h1>{body}</article>{after}<footer>&copy; x</footer></body></html>"


def test_html_article():
    long = "the cat and the dog of the house " * 12
    page = article(f"<p>One &amp; two<br>three<p>short<p>{long}<aside>Related</aside><form>Name <input></form><div class='ad-slot'>Buy</div><!-- c --><style>p{{}}</style>", "<div class=cookie-notice>We use cookies and you agree to all of this and that</div>", f"<section id=comments><p>{long}</section>")
    assert " ".join(H.main_text(page)) == "Head One & two three short " + long.strip()


def test_html_without_article():
    long = "the cat and the dog of the house " * 12
    page = f"<body><div class=menu>Home News</div><div><p>{long}</p><p>Tiny.</p><p>{long}</p></div><div><a href=/>one</a> <a href=/>two</a></div><p>Zq xw vb</p></body>"
    # the short block in the text goes with it, the one after the links goes with them
    assert " ".join(H.main_text(page)) == f"{long.strip()} Tiny. {long.strip()}"


@pytest.mark.parametrize(("inner", "left"), [("Text <button>Share</button> more", "Text more"), ("Text <span class=ad>Buy</span> more", "Text more"), ("Text <a class=share href=/>Tell</a> more", "Text more"), ("Real text <select><option>A</option></select>", "Real text"), ("Real text <button><div>Share</div></button>", "Real text"), ("<span hidden>no</span> Yes", "Yes")])
def test_html_excluded_elements_within_a_line(inner, left):
    long = "the cat and the dog of the house " * 12
    assert H.main_text(f"<body><article><p>{inner}</p></article></body>") == [left]
    assert H.main_text(f"<body><p>{long}</p><p>{inner}</p><p>{long}</p></body>") == [long.strip(), left, long.strip()]
    assert H.main_text("<body><article><div>Real text <span class=promo><div>Buy</div></span></div></article></body>") == ["Real text"]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "text only here", "<p>a<p>b", "</div></p>x", "<script>never closed", "<a href='>unclosed quote", "<p>&bogus; &#65;</p>", "a\0b", "<div " * 3000, "<b>" * 3000 + "x"])
def test_html_odd_pages(page):
    assert all(isinstance(x, str) and x == " ".join(x.split()) for x in H.main_text(page))


def test_html_operator(spark):
    d = spark.createDataFrame([(1, "u", "<p>a &lt; b</p>"), (2, None, None), (2, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r.page_id, r.url or "", r.text, r.n_chars) for r in H.extract(d, ["page_id", "url"]).collect()) == [(1, "u", "a < b", 5), (2, "", "", 0), (2, "v", "", 0)]


# ---- language


def sentences(lang, rnd, n):
    stems = {"en": "the and of ing tion with that was", "fr": "le les des que ment eau oi é", "de": "der und die sch ung ein nicht ü"}[lang].split()
    return " ".join("".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language(make):
    rnd = random.Random(7)
    rows = [(3 * i + k, sentences(lang, rnd, rnd.randint(1, 80))) for i in range(80) for k, lang in enumerate(("en", "fr", "de"))]
    d = make([*rows, (900, None), (901, ""), (902, "12 34 --"), (903, "Ŵ" * 5000), (3, rows[3][1])])
    d = d.withColumn("lang", F.when(F.col("doc_id") < 240, F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("doc_id") % 3 + 1).cast("int"))))
    hidden = L.held_out(F.col("doc_id"))
    out = L.identify(d, L.fit(d, ~hidden), ["doc_id", "lang", "text", "label"]).withColumn("hidden", L.held_out(F.col("doc_id"))).collect()
    real = [r for r in out if r.doc_id < 240 and r.hidden and len(r.text) > 30]
    assert sum(r.lang == r.lang_pred for r in real) >= 0.95 * len(real) and len(out) == 245
    assert all(r.lang_pred == "und" and r.rejected and r.score == 0 for r in out if r.doc_id in (900, 901, 902))
    assert not any(r.rejected for r in out if r.doc_id < 240) and all(0 <= r.score <= 1 for r in out)
    (strange,) = [r for r in out if r.doc_id == 903]
    assert strange.score < min(r.score for r in real)


def slow_nearest(model, text):
    """Language, cosine and rejection by comparing one text's grams with every centroid."""
    data = " ".join(re.sub(rb"[^a-z\x80-\xff]+", b" ", text.lower().encode()).decode("utf-8", "surrogateescape").split(" ")).encode("utf-8", "surrogateescape")
    n = np.zeros(L.DIM)
    for k in range(3):
        for i in range(len(data) - k):
            gram = int.from_bytes(data[i : i + k + 1], "big") + k + 1
            n[(gram * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
    x = np.log1p(n) * model.idf
    x /= max(np.linalg.norm(x), 1e-12)
    cos = [float(x @ c) for c in model.centroids]
    top = max(cos)
    return {lang for lang, c in zip(model.langs, cos, strict=True) if c > top - 1e-6}, top, top < model.floor[int(math.log2(max(n.sum(), 1)))]


def test_language_equals_slow_nearest_centroid(make):
    rnd = random.Random(8)
    rows = [(3 * i + k, sentences(lang, rnd, rnd.randint(1, 60))) for i in range(40) for k, lang in enumerate(("en", "fr", "de"))]
    rows += [(500 + k, t) for k, t in enumerate(planted(rnd)) if len(t) < 4000] + [(600, "é"), (601, "A-b c"), (602, "x " * 3000)]
    d = make(rows).withColumn("lang", F.when(F.col("doc_id") < 120, F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("doc_id") % 3 + 1).cast("int"))))
    model = L.fit(d, ~L.held_out(F.col("doc_id")))
    texts = dict(rows)
    for r in L.identify(d, model, ["doc_id"]).collect():
        langs, top, rejected = slow_nearest(model, texts[r.doc_id])
        assert r.lang_pred in langs and abs(r.score - min(1, max(0, top))) < 1e-4
        assert r.rejected == rejected or abs(top - model.floor.min()) < 0.5 and abs(top - r.score) < 1e-4 and min(abs(top - model.floor)) < 1e-4


def test_kept_columns_with_names_of_new_ones(spark, make, model):
    d = make([(1, "the one"), (2, None)]).selectExpr("doc_id", "text", "lang", "'a' AS score", "'b' AS rejected", "'c' AS _text", "5 AS n_tokens", "'d' AS _kept0", "'e' AS html")
    out = L.identify(d, L.fit(d, F.lit(True)), d.columns)
    assert out.columns == ["doc_id", "text", "lang", "score_in", "rejected_in", "_text", "n_tokens", "_kept0", "html", "lang_pred", "score", "rejected"]
    assert [(r.score_in, r.rejected_in, r._text, r.rejected) for r in out.collect()] == [("a", "b", "c", True)] * 2
    assert [(r.n_tokens_in, r._text) for r in C.token_counts(d, model, ["n_tokens", "_text"], rank_scores=True).collect()] == [(5, "c")] * 2
    assert H.extract(d, ["text", "html"]).columns == ["text_in", "html", "text", "n_chars"] and len(H.extract(d, ["text", "html"]).collect()) == 2
    kept = L.accepted(d, L.fit(d, F.lit(True)))
    assert kept.columns == d.columns and kept.collect() == []


def test_very_long_texts(make, model):
    long = "the and of ing tion with that was " * 60_000
    d = make([(1, long), (2, "le la les des que ment eau oi " * 50), (3, "the and of ing tion with that was " * 50)]).withColumn("lang", F.when(F.col("doc_id") == 2, "fr").when(F.col("doc_id") == 3, "en"))
    out = {r.doc_id: r for r in L.identify(d, L.fit(d, F.lit(True)), ["doc_id"]).collect()}
    assert out[1].lang_pred == "en" and not out[1].rejected
    counts = {r.doc_id: r.n_tokens for r in C.token_counts(d, model, ["doc_id"], rank_scores=True).collect()}
    assert counts[1] > 1000 * counts[3]


def test_language_without_labels(make):
    d = make([(1, "some text"), (2, None)])
    assert [(r.lang_pred, r.rejected) for r in L.identify(d, L.fit(d, F.lit(True)), ["doc_id"]).collect()] == [("und", True)] * 2
    e = make([])
    assert L.identify(e, L.fit(e, F.lit(True)), ["doc_id"]).collect() == []


def planted(rnd):
    """Junk of several kinds and sizes, each text with letters."""
    kinds = [
        lambda n: base64.b64encode(rnd.randbytes(n)).decode()[:n],
        lambda n: " ".join("".join(rnd.choice("бвгджзклмнпрстфхцчш") for _ in range(5)) for _ in range(n // 11 + 1)),
        lambda n: "".join(chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(n // 3)),
        lambda n: " ".join("".join(rnd.choice("bcdfghjklmpqvwxyz") for _ in range(7)) for _ in range(n // 8 + 1)),
    ]
    return [f(n) for f in kinds for n in (40, 90, 400, 3000, 50_000)]


@pytest.mark.parametrize("per_lang", [12, 40, 400])
def test_language_rejects_junk_of_every_size(make, per_lang):
    rnd = random.Random(per_lang)
    clean = [(lang, sentences(lang, rnd, rnd.choice([8, 20, 60, 300]))) for _ in range(per_lang) for lang in ("en", "fr", "de")]
    junk = planted(rnd)
    d = make([(k, t) for k, (_, t) in enumerate(clean)] + [(10_000 + k, t) for k, t in enumerate(junk)])
    langs = F.element_at(F.array(*map(F.lit, ("en", "fr", "de"))), (F.col("doc_id") % 3 + 1).cast("int"))
    d = d.withColumn("lang", F.when(F.col("doc_id") < 10_000, langs))
    out = {r.doc_id: r.rejected for r in L.identify(d, L.fit(d, ~L.held_out(F.col("doc_id"))), ["doc_id"]).collect()}
    assert [t[:30] for k, t in enumerate(junk) if not out[10_000 + k]] == []
    assert [k for k in range(len(clean)) if out[k]] == []
