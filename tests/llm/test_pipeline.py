"""The pipeline: what each stage drops and keeps, and its columns."""

import random

import numpy as np
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_exact_substring import brute as without_repeats
from test_texts import slow_nearest

import corpus_pipeline as P
from textlattice.llm import language as L, simhash as S
from textlattice.llm.mixing import DOMAINS


def test_stages(spark, tmp_path):
    rnd = random.Random(11)
    vocab = [f"{a}{b}{c}" for a in ("the", "an", "in", "or") for b in ("", "ti", "er", "on") for c in ("", "ly", "ed", "st")]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    passage, exam = text(60), [text(40) for _ in range(3)]
    docs = [(i, text(rnd.randint(120, 300)), "en", "s", 0) for i in range(40)]
    docs += [(50, docs[3][1], "en", "s", 0), (51, docs[4][1].replace("the", "THE", 1), "en", "s", 0), (51, docs[4][1], "en", "s", 0)]
    docs += [(60 + k, text(150) + " " + passage, "en", "s", 0) for k in range(3)]
    docs += [(70, text(20) + " " + exam[0], "en", "s", 0), (71, text(2000) + " " + exam[1], "en", "s", 0), (80, None, None, "s", None), (81, "12 --", "en", "s", 5)]
    clash = ["rejected", "score", "lang_pred", "_text", "n_words", "kept", "removed", "id", "g", "fp", "label", "rate"]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    d.selectExpr("*", *(f"'{c}' AS {c}" for c in clash)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(exam)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, d, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *clash]
        out.write.parquet(f"{tmp_path}/stage{k}")
        d = spark.read.parquet(f"{tmp_path}/stage{k}")
        kept.append(sorted(r.doc_id for r in d.collect()))
    everyone = sorted(x[0] for x in docs)
    assert kept[0] == [i for i in everyone if i not in (80, 81)]
    assert kept[1] == [i for i in kept[0] if i not in (50, 51)]
    assert kept[2] == kept[1]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage2").collect()}
    assert all(r[c] == c for r in spark.read.parquet(f"{tmp_path}/stage3").collect() for c in clash)
    assert passage in texts[60] and passage not in texts[61] and passage not in texts[62]
    assert kept[3] == [i for i in kept[2] if i != 70] and kept[4] == kept[3]
    assert sorted(r.doc_id for r in P.run(spark, str(tmp_path)).collect()) == kept[4]


def test_equals_brute_force(spark, tmp_path):
    """Every stage by a slow version of its own, in this process."""
    rnd = random.Random(21)
    vocab = {"en": "the and of ing tion with that was her out".split(), "fr": "le les des que ment eau oi une dans pas".split()}
    text = lambda lang, n: " ".join("".join(rnd.choice(vocab[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))
    passages, exam = [text("en", 30) for _ in range(3)], [text("en", rnd.choice([8, 13, 40])) for _ in range(4)]
    docs = []
    for i in range(90):
        lang = rnd.choice(["en", "en", "fr"])
        body = " ".join([text(lang, rnd.randint(5, 200)), *(rnd.choice([*passages, *exam]) for _ in range(rnd.randint(0, 2))), text(lang, rnd.randint(0, 60))])
        docs.append((i, body, lang))
    docs += [(100 + k, docs[rnd.randrange(60)][1], "en") for k in range(10)] + [(120, "12 34", "en"), (121, None, None), (122, "бвгд жзкл мнпр " * 30, None), (None, text("en", 50), "en"), (5, text("fr", 40), "fr")]
    d = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(exam)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 3 > 0, i % 7 == 0) for i in range(60)], "doc_id long, quality boolean, toxic boolean").selectExpr("doc_id", "int(quality) AS quality", "int(toxic) AS toxic").write.parquet(f"{tmp_path}/labels.parquet")

    model = L.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), ~L.held_out(F.col("doc_id")))
    rows = [(i, t) for i, t, _ in docs if t and L.has_letters(t) and not slow_nearest(model, t)[2]]
    assert {i for i, _ in rows}.isdisjoint({120, 121, 122})
    fps = [S.fingerprint(t.encode(), S.WIDE) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= S.NEAR and group[a] != group[b]:
                group = [min(group[a], group[b]) if g in (group[a], group[b]) else g for g in group]
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0)
    rows = [rows[k] for k in sorted({g: min((k for k in range(len(rows)) if group[k] == g), key=order) for g in group}.values())]
    left = {(i, n, gone): kept for i, n, gone, kept in without_repeats(rows)}
    cut = {(i, n): (gone, kept) for (i, n, gone), kept in left.items()}
    rows = [(i, t if cut[i, len(t.split())][0] == 0 else cut[i, len(t.split())][1]) for i, t in rows if cut[i, len(t.split())][0] < len(t.split())]
    rows = [(i, t) for i, t in rows if not hits([(i, t)], list(enumerate(exam)))[0][4]]

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(P.STAGES[:4]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/s{k}")
        now = spark.read.parquet(f"{tmp_path}/s{k}")
    assert sorted(((r.doc_id, r.text) for r in now.collect()), key=repr) == sorted(rows, key=repr)
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out) == sorted((i or -1, len(t.split())) for i, t in rows)
    names = sorted(DOMAINS)
    p, t, rate = np.array([[r[f"p_{n}"] for n in names] for r in out]), np.array([r.n_tokens for r in out]), np.array([r.rate for r in out])
    v, b = np.zeros(3), np.array([DOMAINS[n] for n in names])
    for _ in range(20_000):
        v += 0.5 * ((np.maximum(0, 1 - p @ v) * t) @ p / t.sum() - b)
    assert np.average((rate - np.maximum(0, 1 - p @ v)) ** 2, weights=t) ** 0.5 < 0.1


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("benchmark", "item_id long, text string"), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
