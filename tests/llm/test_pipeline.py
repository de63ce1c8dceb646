"""The pipeline keeps clean documents and their columns, and takes out what it should."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest

from winnowlake.llm import langid

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
            assert out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
            assert out.count() >= 0.6 * docs.count()
        else:
            assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"] and out.count() == docs.count()
        docs = out


def test_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_language_id_rejects_what_fits_no_learned_language(spark):
    rng = random.Random(8)
    en = "the quick brown fox jumps over lazy dog and then it sleeps near river bank while we walk home".split()
    de = "der schnelle braune Fuchs springt über den faulen Hund und schläft dann am Ufer des Flusses".split()
    prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, prose(de if k % 2 else en, rng.randint(5, 60)), "de" if k % 2 else "en", "s", 1) for k in range(600)]
    clean = [prose(en, 3), prose(de, 30), prose(en, 20) + " 🐀🐁🐂 +1 (168) 555-5254 of.92@mail6.example.com", "1234"]
    bad = [
        " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(30)),
        "To jest zdanie po polsku, którego model nie zna wcale i nigdy nie widział", "これは日本語の文章です。モデルは知りません", "Это предложение на русском языке, которого модель не знает",
    ]
    rows += [(1000 + k, t, None, "s", 1) for k, t in enumerate(clean)] + [(2000 + k, t, None, "s", 1) for k, t in enumerate(bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(600), 1000, 1001, 1002}
    no_label = docs.where("doc_id >= 2000")  # nothing is learned: nothing is told
    assert corpus_pipeline.language_id(spark, no_label, SF).count() == 0


def test_language_id_learns_from_all_labelled_rows(spark, monkeypatch):
    words = {"en": "the quick brown fox jumps over lazy dog".split(), "de": "der schnelle braune Fuchs springt über den faulen Hund".split(), "cy": "mae hen wlad fy nhadau yn annwyl i mi".split()}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(rng.randint(1, 6))), x) for k in range(45_000) for x in ["cy" if k % 500 == 0 else "de" if k % 3 else "en"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    seen = {}
    monkeypatch.setattr(langid, "accepted", lambda docs, u, within: seen.update(u=u, within=within) or docs)
    corpus_pipeline.language_id(spark, docs, SF)
    u, within = seen["u"], seen["within"]

    counts, held = {x: np.zeros(u.p.shape[0] - 5) for x in words}, defaultdict(list)
    for k, text, x in rows:
        if zlib.crc32(str(k).encode()) % 3 == 1:
            held[x].append(text)
        else:
            np.add.at(counts[x], langid.model(u.path).library.encode(text.lower()), 1)
    assert u.langs == ["cy", "de", "en"] and (u.log_p == langid.Unigrams({x: counts[x] for x in u.langs}, u.path).log_p).all()
    langid._judge(u, ["warm"])
    assert set(within) == set(words) and len(held["cy"]) < 60
    for x, texts in held.items():
        _, part, points = u.told(texts, True)
        usual, low = np.quantile(part[:, u.langs.index(x)] / points, [0.5, 0.01])
        assert within[x] == pytest.approx((usual, 2 * (usual - low)), rel=1e-12, abs=1e-12)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    values = {"one": [-3.25], "two": [-1.0, -2.0], "same": [-4.0] * 500, "many": (-2 - rng.random(3000) / 9).tolist(), "copies": [-7.5] * 700 + rng.normal(-3, 1, 301).tolist()}
    rows = spark.createDataFrame([(x, v) for x, vs in values.items() for v in vs], "lang string, value double").repartition(5)
    found = langid.quantiles(rows, [0.5, 0.01, 0.0, 1.0])
    assert {x: n for x, (n, _) in found.items()} == {x: len(vs) for x, vs in values.items()}
    assert all(found[x][1] == np.quantile(vs, [0.5, 0.01, 0.0, 1.0]).tolist() for x, vs in values.items())
    assert langid.quantiles(rows.limit(0), [0.5]) == {}
