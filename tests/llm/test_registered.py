"""The registered queries as returned, over tables with odd rows and columns of clashing names; the pipeline too."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline
from winnowlake.llm import common, decontaminate, piece_bpe, simhash

rng = random.Random(5)
EN = "the quick brown fox jumps over lazy dogs and then it sleeps near a river bank while we walk home with our friends".split()
DE = "der schnelle braune Fuchs springt über den faulen Hund und schläft dann am Ufer des Flusses bei seinen Freunden".split()
PASSAGE = "zulu yankee xray whiskey victor uniform tango sierra romeo quebec papa oscar"
prose = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
LONG = prose(EN, 30_000)
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "id", "row", "rid", "b_id", "b_digest", "__digest", "kind", "runs"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, rid long, b_id long, b_digest long, __digest long, kind int, runs string"


def rows_of():
    texts = [(k, prose(DE if k % 2 else EN, rng.randint(25, 60)), "de" if k % 2 else "en") for k in range(120)]
    texts += [(200, None, "en"), (201, "", None), (202, " \t\n", "de"), (203, LONG, "en"), (None, prose(EN, 40), "en"), (None, prose(EN, 40), None), (204, "$$$ ### *** " * 40, "en"), (205, "word " * 3, "en")]
    texts += [(210 + k, "$$$ ### *** buy now " * rng.randint(20, 50), "en") for k in range(12)]
    texts += [(300, f"{prose(EN, 30)} {PASSAGE.upper()} {prose(EN, 30)}", "en"), (301, PASSAGE, "en"), (302, "日本語 " * 20, None)]
    texts += [texts[5], texts[5], (400, texts[7][1], "de"), (401, texts[7][1], "de")]
    return [(i, t, x, f"s{n % 3}" if n % 5 else None, None if t is None else len(t), 9, "r", 1, 2, 3, 4, 5, "q") for n, (i, t, x) in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, rows):
    d = f"file:{tmp_path_factory.mktemp('sf')}"
    write(spark, d, rows)
    return d


def write(spark, d, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int("$$$" not in (r[1] or "")), 0, 7, "x") for r in rows if r[0] is not None] + [(None, 1, 0, 7, "x"), (3, None, 0, 7, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, id long, text string").write.parquet(f"{d}/labels.parquet")
    bench = [("i2", PASSAGE, 1), ("i1", "quebec papa oscar", 1), ("i0", None, 1), (None, "no such words", 1)]
    spark.createDataFrame(bench, "item_id string, text string, rid int").write.parquet(f"{d}/benchmark.parquet")
    pages = [(k, f"https://a.org/{k}", f"<nav><a>{prose(EN, 2)}</a></nav><article><h1>{k}</h1><p>{prose(EN, 20)}</p></article>", "h", "t") for k in range(8)] + [(8, None, None, "h", "t"), (9, "", "<p>x", "h", "t")]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string, template string").write.parquet(f"{d}/pages.parquet")


def got(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    return df, df.collect()


def crc(i, mod):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod


FOLDS = {"op1_lm_scoring": (5, 1), "op4_quality_classifier": (4, 2), "op10_language_id": (3, 1)}


@pytest.mark.parametrize("name", FOLDS)
def test_folds_and_scores(spark, sf, rows, name):
    df, out = got(spark, sf, name)
    mod, left_out = FOLDS[name]
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert all(r["held_out"] == (crc(r["doc_id"], mod) == left_out) for r in out)
    types = dict(df.dtypes)
    if name == "op1_lm_scoring":
        assert df.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and types["n_tokens"] == types["n_known"] == types["train_tokens"] == "bigint"
        assert {r["doc_id"]: r["n_tokens"] for r in out}[203] == 30_001 and all(r["score"] < 0 and r["base_score"] < 0 for r in out)
        long = next(r for r in out if r["doc_id"] == 203)
        assert long["score"] > long["base_score"]
    else:
        assert all(0 <= r["score"] <= 1 for r in out)
    if name == "op4_quality_classifier":
        assert types["predicted"] == "int" and all(r["predicted"] == int(r["score"] >= 0.7) for r in out)
        by = {r["doc_id"]: r["score"] for r in out}
        assert by[204] < 0.7 <= by[10]
    if name == "op10_language_id":
        by = {r["doc_id"]: r["lang_pred"] for r in out}
        assert [by[k] for k in (200, 201, 202)] == ["und"] * 3 and all(by[k] == ("de" if k % 2 else "en") for k in range(120)) and by[203] == "en"


def test_fingerprints_and_components(spark, sf, rows):
    _, out = got(spark, sf, "op2_simhash")
    want = Counter((r[0], f"{simhash.fingerprint((r[1] or '').encode()):016x}") for r in rows)
    assert Counter((r["doc_id"], r["fingerprint"]) for r in out) == want
    by = {r["doc_id"]: r["component_id"] for r in out}
    assert by[400] == by[401] == by[7] == 7 and by[200] == by[201] == by[202] == 200 and by[5] == 5


def test_tokens(spark, sf, rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(piece_bpe.MODEL))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    ids = [(r[0], r[1] or "", lib.encode(r[1] or "")) for r in rows]
    _, out = got(spark, sf, "op3_sentencepiece")
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == Counter((i, len(x), sha(",".join(map(str, x))), sha(lib.decode(x))) for i, _, x in ids)
    _, out = got(spark, sf, "op9_token_counts")
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out) == Counter((i, len(t.encode()), len(x), len(x) > 4096) for i, t, x in ids)


def test_rules_and_decontamination(spark, sf, rows):
    df, out = got(spark, sf, "op5_quality_rules")
    assert df.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert len(out) == len(rows) and all(not (r["base_failed"] and r["kept"]) for r in out) and all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in out)
    _, out = got(spark, sf, "op6_decontamination")
    items = [("i2", PASSAGE), ("i1", "quebec papa oscar"), ("i0", None)]
    want = Counter((r[0], *(x := decontaminate.brute_force(r[1], items))[:3], x[3], x[1] > 0) for r in rows)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in out) == want
    assert next(r for r in out if r["doc_id"] == 300)["items_sha256"] == hashlib.sha256(b"i1,i2").hexdigest()


def test_shards_and_pages(spark, sf, rows):
    df, out = got(spark, sf, "op7_sharding")
    assert df.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and dict(df.dtypes)["grown_shard"] == dict(df.dtypes)["shard"] == "int"
    assert {r["law"] for r in out} == {"rows"} and {r["grown_shard"] for r in out} == {None} and {r["shard"] for r in out} <= set(range(40))
    sizes = Counter(r["shard"] for r in out)
    assert max(sizes.values()) - min(sizes[s] for s in range(40)) <= 1
    _, out = got(spark, sf, "op8_html_text")
    by = {r["page_id"]: r for r in out}
    assert by[8]["text"] == "" and by[9]["text"] == "x" and re.fullmatch(r"3\n\n.{20,}", by[3]["text"]) and all(r["n_chars"] == len(r["text"]) for r in out) and by[3]["by_template"]


def test_pipeline(spark, sf, rows):
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    assert docs.columns == NAMES
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, sf), name)
        assert docs.columns == NAMES and docs.schema.simpleString() == before.schema.simpleString()
        out = docs.collect()
        kept[name] = Counter(r["doc_id"] for r in out)
        texts = {r["doc_id"]: r["text"] for r in out}
        assert all(tuple(r)[5:] == (9, "r", 1, 2, 3, 4, 5, "q") for r in out)
    clean = [k for k in range(120) if k not in (5, 7)]
    assert not {200, 201, 202} & set(kept["language_id"]) and all(kept["language_id"][k] for k in clean) and kept["language_id"][5] == 3
    assert not {204, 205, *range(210, 222)} & set(kept["quality_rules"]) and all(kept["quality_rules"][k] for k in clean)
    # one of each group of fingerprints that link, by loops over all pairs
    fps = [(i, simhash.fingerprint(t.encode())) for i, t, *_ in rows if i in kept["quality_rules"] or i is None]
    group = {i: min(j for j, g in fps if j is not None and (f ^ g).bit_count() <= 4) for i, f in fps if i is not None}
    assert {i for i in kept["simhash_dedup"] if i is not None} == set(group.values()) & set(kept["quality_rules"]) and kept["simhash_dedup"][5] == kept["simhash_dedup"][7] == 1 and not kept["simhash_dedup"][400]
    assert 300 in kept["decontamination"] and 301 not in kept["decontamination"] and "ZULU" not in texts[300] and "OSCAR" not in texts[300]
    assert all(texts[k] == rows[k][1] for k in clean if k in texts) and set(kept["simhash_dedup"]) - {301} == set(kept["decontamination"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    lib = sentencepiece.SentencePieceProcessor(model_file=common.tokenizer_path(piece_bpe.MODEL))
    assert {r["doc_id"]: list(r["ids"]) for r in out.collect() if r["doc_id"] is not None} == {i: lib.encode(t) for i, t in texts.items() if i is not None}
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.run(spark, sf).collect()) == sorted(map(str, kept["decontamination"].elements()))


def test_all_queries_take_empty_tables(spark, sf, tmp_path):
    for t in ("documents", "labels", "benchmark", "pages"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"file:{tmp_path}/{t}.parquet")
    for name in [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]:
        assert entry.queries()[name](spark, f"file:{tmp_path}").count() == 0
