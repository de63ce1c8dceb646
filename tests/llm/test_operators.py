"""The ten operators against plain loops, on small fixtures with the odd cases in them."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from winnowlake.llm import ctw, decontaminate, html_text, langid, piece_bpe, quality_ftrl, quality_rules, sharding, simhash, token_count
from winnowlake.llm.common import crc_mod, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EN = "The quick brown fox jumps over the lazy dog and then it sleeps near the river bank".split()
DE = "Der schnelle braune Fuchs springt über den faulen Hund und schläft dann am Ufer des Flusses".split()
rng = random.Random(3)
LONG = " ".join(rng.choice(EN) for _ in range(6000))
TEXTS = [
    None, "", " \t\n ", "one", "a b c", "x" * 5000, "ÀÉ ß naïve 日本語 🙂🙂 <s></s>", "line one\nline one\nline two\n\n", "  two  spaces ▁mark ▁▁ end ", LONG, LONG, LONG + " tail",
    *(" ".join(rng.choice(EN) for _ in range(40)) for _ in range(12)), *(" ".join(rng.choice(DE) for _ in range(40)) for _ in range(12)),
    "copy of the same words again and again " * 6, "#*$ %& |<> buy now!!! $$$ " * 12,
]
#: A clashing and an extra column are part of every table.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "de" if t and "Hund" in t or t and "Fuchs" in t else "en", None if k % 7 == 0 else f"s{k % 3}", 0, 9, "r") for k, t in enumerate(TEXTS)]
    rows += [(None, "null id here", None, "s1", None, None, None), rows[12], rows[12]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return WORD.findall(t or "")


def train(i, mod, out):
    return zlib.crc32(("" if i is None else str(i)).encode()) % mod != out


def test_lm_scoring_against_a_recursive_tree(spark, docs, empty):
    depth = 3
    rows = [r for r in docs.select("doc_id", "text").collect() if not r["text"] or len(r["text"]) < 1000]
    small = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["n_tokens"], r["n_bytes"]): r for r in ctw.score(small, crc_mod("doc_id", 5) != 1, depth, hot_bytes=50 * 42, block=200).collect()}

    def stream(t):
        return b" ".join((t or "").encode().lower().split()) + b"\n"

    counts = Counter()
    for r in rows:
        if train(r["doc_id"], 5, 1):
            s = b"\n" * depth + stream(r["text"])
            for k in range(depth, len(s)):
                for d in range(depth + 1):
                    for j in range(8):
                        counts[s[k - d : k], j, s[k] >> (8 - j), s[k] >> (7 - j) & 1] += 1
    known = {}
    for ctx, j, z, _ in counts:
        known.setdefault((len(ctx), j, z), set()).add(ctx)

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    memo = {}

    def weight(ctx, j, z):
        if (ctx, j, z) not in memo:
            pe = log_kt(counts[ctx, j, z, 0], counts[ctx, j, z, 1])
            if len(ctx) == depth:
                memo[ctx, j, z] = (pe, pe, 1.0)
            else:
                kids = sum(weight(c, j, z)[1] for c in known.get((len(ctx) + 1, j, z), ()) if c[1:] == ctx)
                w = math.log(math.exp(pe - max(pe, kids)) + math.exp(kids - max(pe, kids))) + max(pe, kids) - math.log(2)
                memo[ctx, j, z] = (pe, w, math.exp(pe - math.log(2) - w))
        return memo[ctx, j, z]

    def predict(s, k, j):
        z, bit, p = s[k] >> (8 - j), s[k] >> (7 - j) & 1, 0.5
        for d in range(depth, -1, -1):
            ctx = s[k - d : k]
            n = counts[ctx, j, z, 0] + counts[ctx, j, z, 1]
            if n:
                kt = (counts[ctx, j, z, bit] + 0.5) / (n + 1)
                stop = weight(ctx, j, z)[2]
                p = stop * kt + (1 - stop) * p
        return p

    tokens = Counter(w for r in rows if train(r["doc_id"], 5, 1) for w in [x.translate(LOWER) for x in words(r["text"])] + ["\n"])
    total, distinct = sum(tokens.values()), len(tokens)
    for r in rows:
        s = b"\n" * depth + stream(r["text"])
        want = sum(math.log10(predict(s, k, j)) for k in range(depth, len(s)) for j in range(8))
        own = [w.translate(LOWER) for w in words(r["text"])] + ["\n"]
        out = got[r["doc_id"], len(own), len(s) - depth]
        assert out["score"] == pytest.approx(want, rel=1e-4)
        assert out["base_score"] == pytest.approx(sum(math.log10((tokens[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own), rel=1e-9)
        assert (out["n_known"], out["train_tokens"]) == (sum(tokens[w] > 0 for w in own), total)
    assert ctw.score(empty, crc_mod("doc_id", 5) != 1, depth).count() == 0


def test_simhash_components(docs, empty):
    def fp(t):
        w = [x.translate(LOWER) for x in words(t)]
        grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = docs.select("doc_id", "text").collect()
    fps = [fp(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 4 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((r["doc_id"] for r, x in zip(rows, group, strict=True) if x == g and r["doc_id"] is not None), default=None) for g in group}
    want = sorted((str(r["doc_id"]), f, least[g]) for r, f, g in zip(rows, fps, group, strict=True))
    got = sorted((str(r["doc_id"]), r["fp"] & (2**64 - 1), r["component"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.deduplicated(empty).count() == 0


def test_simhash_tiles_lose_no_link(spark):
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.choice([3, 4, 5]))) for v in values]
    signed = [v - (v >> 63 << 64) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=8)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    for a in range(len(values)):
        for b in range(a):
            if (values[a] ^ values[b]).bit_count() <= 4:
                assert roots.get(signed[a], signed[a]) == roots.get(signed[b], signed[b])
    for k in range(150):  # random values are far from one another: five bits do not link
        if (values[k] ^ values[k + 150]).bit_count() == 5:
            assert roots.get(signed[k], signed[k]) != roots.get(signed[k + 150], signed[k + 150])


def test_sentencepiece_is_the_library(docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_bpe.MODEL))
    for r in docs.select("doc_id", "text").join(piece_bpe.encoded(docs.dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]), columns=("ids", "decoded", "n_tokens", "ids_sha256")), "doc_id").collect():
        ids = lib.encode(r["text"] or "")
        assert (list(r["ids"]), r["decoded"], r["n_tokens"]) == (ids, lib.decode(ids), len(ids))
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    model = piece_bpe.model(tokenizer_path(piece_bpe.MODEL))
    odd = ["".join(rng.choice("ab c▁ the\né🙂-.ẞ日") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    assert list(model.encode(odd)) == lib.encode(odd)
    right, model.library = model.library, type("Wrong", (), {"encode": staticmethod(lambda x: [[1]] * len(x))})()
    try:  # a difference from the library is an error, never its ids in silence
        with pytest.raises(ValueError, match="the library"):
            model.learn(["never met before"])
    finally:
        model.library = right
    assert piece_bpe.encoded(empty).count() == 0


def test_token_counts_are_the_library(spark, docs, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(piece_bpe.MODEL))
    odd = ["".join(rng.choice("ab c▁ the\né🙂-.") for _ in range(rng.randint(1, 1500))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate([*TEXTS, *odd])), "doc_id long, text string")
    for r in df.join(token_count.token_counts(df).withColumnRenamed("id", "doc_id"), "doc_id").collect():
        t = r["text"] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(lib.encode(t)), len(t.encode())), t[:80]
    assert token_count.token_counts(empty).count() == 0


def marked(spark, docs):
    return spark.createDataFrame([(k, int("$$$" not in (t or "") and len(words(t)) > 5), 0) for k, t in enumerate(TEXTS)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_quality_classifier(spark, docs, empty):
    labels = marked(spark, docs)
    rows = quality_ftrl.labelled(docs, labels, crc_mod("doc_id", 4) != 2)
    w, b = quality_ftrl.fit_ftrl(rows)
    out = quality_ftrl.scored(docs, w, b).collect()
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)
    by = {r["doc_id"]: r["score"] for r in out}
    assert by[20] > 0.5 and quality_ftrl.scored(empty, w, b).count() == 0
    assert {round(r["score"], 9) for r in quality_ftrl.scored(docs, *quality_ftrl.fit_ftrl([])).collect()} == {0.5}


def test_quality_rules(spark, docs, empty):
    rules = quality_rules.fit(docs, marked(spark, docs))
    for r in docs.select("doc_id", "text").dropna(subset=["doc_id"]).dropDuplicates(["doc_id"]).join(quality_rules.judged(docs, rules).dropDuplicates(["doc_id"]), "doc_id").collect():
        t = r["text"] or ""
        w = words(t)
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(hit) > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judged(docs, rules, keep_columns=True).columns == docs.columns
    assert quality_rules.judged(empty, rules).count() == 0


def test_decontamination(spark, docs, empty):
    passage = " ".join(EN[:12]) + " over there"
    items = [("1", passage), ("2", "zulu yankee xray"), ("3", ""), ("4", None), (None, "tango sierra"), ("2", "zulu yankee xray")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    more = [(100, f"before it {passage.upper()}, after", "en", "s", 1, 1, "r"), (101, "a ZULU-yankee; xray b " * 3 + "clean words follow here and stay", "en", "s", 1, 1, "r"), (102, "tango sierra x y z w q", "en", "s", 1, 1, "r")]
    df = docs.union(spark.createDataFrame(more, SCHEMA))
    for block in (1 << 20, 30):
        for r in decontaminate.contamination(df, bench, block_bytes=block).collect():
            n, hit, k, sha = decontaminate.brute_force(r["text"], [(i, t) for i, t in set(items) if i is not None])
            if r["id"] != 102:
                assert (r["n_words"], sum(x["hi"] - x["lo"] for x in r["runs"]), len(r["items"])) == (n, hit, k)
                assert hashlib.sha256(",".join(r["items"]).encode()).hexdigest() == sha
            else:
                assert (len(r["items"]), len(r["runs"])) == (0, 1)
    clean = decontaminate.decontaminated(df, bench)
    assert clean.columns == df.columns and "zulu" not in " ".join((r["text"] or "").lower() for r in clean.collect() if r["doc_id"] == 101)
    assert decontaminate.decontaminated(clean, bench).exceptAll(clean).count() == 0
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_decontamination_does_not_depend_on_blocks(spark, docs):
    w = lambda p, n: [f"{p}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n)]
    one, two, bridge, clean = w("one", 30), w("two", 30), w("bridge", 10), w("clean", 60)
    items = [("1", " ".join(one)), ("2", " ".join(two)), ("3", " ".join(bridge)), ("4", " ".join(w("four", 12))), ("5", None), (None, "tango sierra")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = [
        [*one, *clean[:40], *two],  # 60 of 100 words: goes
        [*one[:20], *clean, *two[:20]],  # 40 of 100: both passages are taken out
        [*clean[:20], *bridge[:5], *one[:12], *bridge[5:], *clean[20:]],  # taking out 1 makes a window of 3
        [*clean[:20], *two[:5], *bridge[:5], *one[:10], *bridge[5:], *two[5:10], *clean[20:]],  # and that one of 2
        clean, one,
    ]
    rows = [(200 + k, " ".join(t), "en", "s", len(" ".join(t)), 1, "r") for k, t in enumerate(texts)]
    df = docs.union(spark.createDataFrame(rows, SCHEMA)).repartition(2)
    order = lambda rows: sorted(map(str, rows))
    want = decontaminate.decontaminated(df, bench)
    by = {r["doc_id"]: r for r in want.collect() if (r["doc_id"] or 0) >= 200}
    assert sorted(by) == [201, 202, 203, 204] and all(by[k]["text"].split() == clean and by[k]["n_chars"] == len(by[k]["text"]) for k in by)
    for block in (40, 200):
        assert len(list(decontaminate.blocks(bench, "item_id", "text", block))) > 1
        got = decontaminate.decontaminated(df, bench, block_bytes=block)
        assert got.columns == df.columns and order(got.collect()) == order(want.collect())


def test_sharding(docs, empty):
    n, out = docs.count(), sharding.stratified_shards(docs, 4).collect()
    sizes = Counter(r["shard"] for r in out)
    assert len(out) == n and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    for src in {r["source"] for r in out}:
        share = Counter(r["shard"] for r in out if r["source"] == src)
        assert max(share[s] for s in sizes) - min(share[s] for s in sizes) <= 2
    assert sorted(map(str, sharding.stratified_shards(docs.repartition(7), 4).collect())) == sorted(map(str, out))
    assert sharding.stratified_shards(empty).count() == 0


def test_html_text(spark):
    menu = "<nav><a href='/'>Home</a></nav><div class=box7><p>Read more of our great stories</p></div>"
    page = lambda k: f"<html><head><title>t</title><style>p{{}}</style></head><body>{menu}<article><h1>Story {k}</h1><p>Fish &amp;\n chips &#233; {k}<br>next</p><div class='comments'><p>nice!</p></div></article><footer>legal</footer></body></html>"
    rows = [(k, f"https://a.example.org/{k}", page(k), "x") for k in range(8)] + [(8, None, None, "x"), (9, "odd", "", "x"), (10, "https://a.example.org/0", page(0), "x"), (11, "https://b.org/x", "<p>plain <b>text</b><p>two<script>x()</script><form>f</form>", "x")]
    out = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, row string")).collect()}
    assert out[3] == "Story 3\n\nFish & chips é 3 next" and out[10] == out[0]
    assert out[8] == out[9] == "" and out[11] == "plain text\n\ntwo"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_language_id(docs, empty):
    u = langid.fit(docs, ~langid.held_out())
    out = langid.predict(docs, u).collect()
    by = {r["doc_id"]: r for r in out}
    assert len(out) == docs.count() and by[0]["lang_pred"] == by[1]["lang_pred"] == by[2]["lang_pred"] == "und"
    assert [by[k]["lang_pred"] for k in range(12, 36)] == ["en"] * 12 + ["de"] * 12 and all(0 <= r["score"] <= 1 for r in out)
    assert langid.accepted(docs, u).columns == docs.columns and langid.predict(empty, u).count() == 0
    langid._judge(u, ["warm"])
    pieces = piece_bpe.model(u.path).pieces

    def total(word, lang):  # all segmentations, one by one
        def walk(at):
            if at == len(word):
                return 1.0
            found = 0.0
            for end in range(at + 1, len(word) + 1):
                p = pieces.get(word[at:end])
                if p:
                    found += u.p[p[1], lang] * walk(end)
                elif end == at + 1:
                    found += u.p[len(u.p) - 5 + len(word[at].encode()), lang] * walk(end)
            return found

        return math.log(walk(0))

    for w in ("fox", "über", "日x", "sleeping"):
        assert u.forward([w])[0].tolist() == pytest.approx([total(piece_bpe.MARK + w, k) for k in range(len(u.langs))])
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty, ~langid.held_out())).collect()} == {"und"}


def test_language_id_of_words_beyond_plain_floats(docs):
    u = langid.fit(docs, ~langid.held_out())
    langid._judge(u, ["warm"])
    clean = [" ".join(EN), " ".join(DE)]
    pieces = piece_bpe.model(u.path).pieces

    def total(word, lang):  # in logs, code point by code point
        sums = [0.0]
        for end in range(1, len(word) + 1):
            found = []
            for at in range(end):
                p = pieces.get(word[at:end])
                if p:
                    found.append(sums[at] + u.log_p[p[1], lang])
                elif at == end - 1:
                    found.append(sums[at] + u.log_p[len(u.log_p) - 5 + len(word[at].encode()), lang])
            sums.append(max(found) + math.log(sum(math.exp(x - max(found)) for x in found)))
        return sums[-1]

    alone = u.texts(clean)
    odd = ["".join(chr(0x1F400 + k) for k in range(12)), "\U0001d4d0" * 15, "\U0001f1e9\U0001f1ea" * 7, "\u16a0" * 22, "\U00010330" * 23, "\U00010330" * 40]
    for w in odd:
        assert u.forward([w, "fox"])[0].tolist() == pytest.approx([total(piece_bpe.MARK + w, k) for k in range(len(u.langs))])
        u.clear()
        got = u.texts([clean[0], f"so {w}", "", *clean, " ", clean[0]])
        assert (got[[0, 3, 4, 6]] == alone[[0, 0, 1, 0]]).all() and (got[[2, 5]] == 0).all()
        lang, score = langid._judge(u, [f"{clean[1]} {w}", w, *clean])
        assert lang[0] == lang[3] == "de" and lang[2] == "en" and (score[[0, 2, 3]] > 0.9).all() and 0 <= score[1] <= 1
