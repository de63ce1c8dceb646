"""Operators against plain loops that share no code with them: features, regression, verdicts, order, templates."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from winnowlake.llm import common, ctw, decontaminate, html_text, langid, piece_bpe, quality_features, quality_ftrl, quality_rules, sharding, simhash, token_count

M = (1 << 64) - 1
R = common._R
rng = random.Random(11)
WORDS = "The quick brown fox jumps over 12 lazy DOGS and 2024 Äpfel !!! $$$ e-mail again again".split()


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


TEXTS = ["", "one", "a b c", text(30), text(200), "x" * 300, "again again again again again", "tab\tand\nline  two", "ÀÉ日本 🙂 42!", text(5) * 20]


def arrow(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


# ---------------------------------------------------------------- hashes
def mix(h):
    h ^= h >> 32
    h = h * 0xD6E8FEB86659FD93 & M
    h ^= h >> 29
    h = h * 0xA0761D6478BD642F & M
    return h ^ (h >> 32)


def span_hash(values):
    return mix(sum((v + 1) * pow(R, k, 1 << 64) for k, v in enumerate(values)) & M)


def test_span_hashes_of_long_texts_are_those_of_short_ones():
    values = np.array([rng.randrange(256) for _ in range(4000)], np.uint8)
    cuts = sorted(rng.sample(range(4000), 60))
    starts, ends = np.array(cuts[:-1]), np.array(cuts[1:])
    want = [span_hash(values[a:b].tolist()) for a, b in zip(starts, ends, strict=True)]
    for step in (1 << 20, 500, 64, 7):  # also spans that are longer than a step
        assert common.hashed_spans(values, starts, ends, step).tolist() == want
    at = np.arange(3990)
    assert common.hashed_spans(values, at, at + 10, 100).tolist() == common.hashed_spans(values, at, at + 10).tolist()


# ---------------------------------------------------------------- operators 4 and 5
def plain_features(t, chars):
    """Buckets and values of a text, by loops over its characters."""
    b = t.encode()
    kind = lambda c: 0 if c in b" \t\n\r\x0b\x0c" else 2 if 0x30 <= c <= 0x39 else 1 if c >= 0x80 or bytes([c]).isalpha() else 3
    tokens, at = [], 0
    while at < len(b):
        end = at
        while end < len(b) and kind(b[end]) == kind(b[at]):
            end += 1
        if kind(b[at]):
            tokens.append((kind(b[at]), b[at:end]))
        at = end
    low = lambda x: bytes(c + 32 if 65 <= c <= 90 else c for c in x)
    h = [mix(min(len(x), 6)) if k == 2 else span_hash(low(x)) for k, x in tokens]
    shape = []
    for k, x in tokens:
        up = sum(65 <= c <= 90 for c in x)
        shape.append(k + 2 if k != 1 else 0 if up == 0 else 1 if up == 1 else 2 if up * 3 >= len(x) * 2 else 3)
    half = quality_features.HALF
    bucket = lambda x, salt: mix((x + salt) & M) & (half - 1)
    out, n = defaultdict(float), len(tokens)
    share = 1 / max(1, n)
    for k in range(n):
        out[bucket(h[k], 1)] += share
        if k:
            out[bucket((h[k] * 0x9E3779B97F4A7C15 & M) ^ h[k - 1], 2)] += share
            out[bucket(shape[k] * 8 + shape[k - 1], 3)] += share
    edges = [1e-9, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9]
    fours = [tuple(h[k : k + 4]) for k in range(n - 3)]
    for salt, x in ((4, sum(h[k] == h[k - 1] for k in range(1, n)) * share), (5, sum(fours.count(f) > 1 for f in fours) * share)):
        out[bucket(sum(e < x for e in edges), salt)] += float(n > 0)
    if chars:
        lb = low(b)
        for k in (3, 5):
            for at in range(len(lb) - k + 1):
                g = lb[at] + 1
                for c in lb[at + 1 : at + k]:
                    g = (g * 0x100000001B3 + c + 1) & M
                out[bucket(g, 5 + k) + half] += 1 / len(lb)
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("chars", [False, True])
def test_features_by_loops(chars):
    got = quality_features.sparse(*arrow(TEXTS), chars)
    weights = np.random.default_rng(1).normal(size=1 << quality_features.BITS).astype(np.float32)
    dots = quality_features.dots(*arrow(TEXTS), weights, chars)
    for t, (k, v), d in zip(TEXTS, got, dots, strict=True):
        want = plain_features(t, chars)
        assert {int(a): pytest.approx(float(b)) for a, b in zip(k, v, strict=True) if b} == want
        assert d == pytest.approx(sum(float(weights[a]) * b for a, b in want.items()), abs=1e-9)


def labelled_rows():
    rows = []
    for k in range(60):
        good = k // 2 % 2
        t = text(20) if good else "buy now " * 5 + text(3)
        (b, v), = quality_features.sparse(*arrow([t]), True)
        rows.append((k * 7 % 1000, good, b.astype(np.int32), v.astype(np.float32)))
    return rows


def plain_ftrl(rows, epochs, alpha, beta, l1, l2):
    """Per coordinate, one update after the other; the intercept is a feature of value 1."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    order = np.random.default_rng(4)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            _, y, k, v = rows[i]
            x = [*zip(k.tolist(), v.tolist(), strict=True), ("intercept", 1.0)]
            p = 1 / (1 + math.exp(-sum(weight(a) * b for a, b in x)))
            for a, b in x:
                g, w = (p - y) * b, weight(a)
                s = (math.sqrt(n[a] + g * g) - math.sqrt(n[a])) / alpha
                z[a], n[a] = z[a] + g - s * w, n[a] + g * g
    return weight, set(z)


def test_regression_by_loops():
    rows = labelled_rows()
    w, b = quality_ftrl.fit_ftrl(rows, epochs=3)
    weight, seen = plain_ftrl(rows, 3, quality_ftrl.ALPHA, quality_ftrl.BETA, quality_ftrl.L1, quality_ftrl.L2)
    assert b == pytest.approx(weight("intercept"), rel=1e-6)
    assert all(w[k] == pytest.approx(weight(k), rel=1e-5, abs=1e-9) for k in seen if k != "intercept") and set(np.flatnonzero(w)) <= seen


def test_verdict_of_quality_rules_by_loops():
    rows = labelled_rows()
    rules = quality_rules.Rules(rows)
    weight, _ = plain_ftrl([r for r in rows if r[0] % 10], quality_ftrl.EPOCHS, quality_ftrl.ALPHA, quality_ftrl.BETA, quality_ftrl.L1, quality_ftrl.L2)
    held = [r for r in rows if r[0] % 10 == 0]
    margins = [sum(weight(a) * b for a, b in zip(k.tolist(), v.tolist(), strict=True)) + weight("intercept") for _, _, k, v in held]
    y = [r[1] for r in held]
    goal = [(sum(y) + 1) / (sum(y) + 2) if t else 1 / (len(y) - sum(y) + 2) for t in y]

    def loss(a, b):  # what Platt's method makes least
        p = [1 / (1 + math.exp(-(a * x + b))) for x in margins]
        return -sum(g * math.log(q) + (1 - g) * math.log(1 - q) for g, q in zip(goal, p, strict=True)) + 5e-4 * ((a - 1) ** 2 + b * b)

    best = loss(rules.slope, rules.shift)
    assert all(best <= loss(rules.slope + da, rules.shift + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    for t, p in zip(TEXTS, rules.probability(*arrow(TEXTS)), strict=True):
        x = sum(weight(a) * b for a, b in plain_features(t, True).items()) + weight("intercept")
        assert p == pytest.approx(1 / (1 + math.exp(-(rules.slope * x + rules.shift))), rel=1e-3)


# ---------------------------------------------------------------- operator 7
def test_sharding_order_by_a_sort(spark):
    rows = [(k, text(k % 9), rng.choice(["hot"] * 6 + ["a", None])) for k in range(400)] + [(None, "x", "a"), (None, "x", "a"), (5, "again", "hot"), (5, "again", "hot")]
    got = sharding.stratified_shards(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), 7)
    keyed = [(src, hashlib.md5(f"7:{f'null:{zlib.crc32(t.encode())}' if i is None else i}".encode()).hexdigest(), i is not None, i or 0, zlib.crc32(t.encode()), len(t.encode()) + 16) for i, t, src in rows]
    by_source = defaultdict(list)
    for r in keyed:
        by_source[r[0]].append(r)
    ranked = []
    for src, part in by_source.items():
        part.sort(key=lambda r: r[1:])
        ranked += [((2 * k + 1) / (2 * len(part)), (src is not None, src or ""), *r[1:]) for k, r in enumerate(part)]
    ranked.sort()
    n = len(ranked)
    shard = [k * 7 // n for k in range(n)]
    want = sorted((r[4] if r[3] else -1, r[5], r[6], s, k - (s * n + 6) // 7) for k, (r, s) in enumerate(zip(ranked, shard, strict=True)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text_crc32"], r["size"], r["shard"], r["slot"]) for r in got.collect()) == want


# ---------------------------------------------------------------- operator 8
def site(host, k, words):
    links = "".join(f"<li><a href='/{rng.random()}'>{text(1)}</a></li>" for _ in range(rng.randint(3, 6)))
    return f"https://{host}/{k}", f"<body><div class='x1'><ul>{links}</ul></div><div id=c7><h1>{words} title</h1><div class=body><p>{words} first {k}</p><p>{words} second</p></div></div><div class='zz'>{text(4)} {k}</div><section>Same on all pages</section></body>"


def test_templates_by_counts_over_hosts(spark):
    """Sites without telling tags or classes: what is left is told by recurring shapes and texts alone."""
    pages = [(n, *site(host, n, text(12))) for n, host in enumerate(["a.org"] * 12 + ["b.org"] * 3 + ["c.org"] * 6)]
    pages += [(100 + k, pages[0][1], pages[0][2]) for k in range(5)]  # copies count once
    out = {r["page_id"]: r for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    hosts = defaultdict(lambda: defaultdict(set))
    for _, url, html in pages:
        say, found = html_text.candidates(html_text.parse(html))
        for d in (None, *found):
            hosts[url.split("/")[2]][d].add(say)
    for n, url, html in pages:
        count = hosts[url.split("/")[2]]
        known = {d for d, s in count.items() if d is not None and len(s) >= 5 and len(s) >= 0.2 * len(count[None])}
        assert (out[n]["text"], out[n]["by_template"]) == html_text.extract(html_text.parse(html), known)
        title, first, second = (re.sub("<[^>]*>", "", x) for x in re.findall(r"<h1>.*?</h1>|<p>.*?</p>", html))
        if "b.org" in url:  # too few pages to tell
            assert not out[n]["by_template"] and "Same on all pages" in out[n]["text"]
        else:
            assert out[n]["by_template"] and out[n]["text"] == f"{title}\n\n{first}\n\n{second}"


def test_rows_of_templates_are_joined_where_they_are_too_many_to_broadcast(spark):
    pages = spark.createDataFrame([(n, *site("a.org", n, text(12)), "x", "y") for n in range(9)], "page_id long, url string, html string, host string, template string")
    one, two = (sorted(map(str, html_text.main_text(pages, broadcast_rows=n).collect())) for n in (500_000, 0))
    assert one == two and "host='x'" in one[0]


# ---------------------------------------------------------------- operator 10
def test_text_scores_are_sums_over_words():
    path = common.tokenizer_path(piece_bpe.MODEL)
    size = piece_bpe.model(path).library.vocab_size()
    u = langid.Unigrams({"a": np.random.default_rng(1).random(size) * 9, "b": np.random.default_rng(2).random(size) * 9}, path)
    langid._judge(u, ["warm"])
    texts = ["", "one", "fox one fox", "ÜBER  das\tHaus", "日本語 one"]
    for t, got in zip(texts, u.texts(texts), strict=True):
        assert got.tolist() == pytest.approx([sum(u.forward([w])[0][k] for w in t.lower().split()) for k in (0, 1)])
    lang, score = langid._judge(u, texts)
    assert lang[0] == "und" and score[0] == 0
    for t, x, s in zip(texts[1:], lang[1:], score[1:], strict=True):
        a, b = u.texts([t])[0]
        assert x == ("a" if a >= b else "b") and s == pytest.approx(1 / (1 + math.exp(-abs(a - b))))


# ---------------------------------------------------------------- operator 9
def test_maps_of_chunks_compose():
    import sentencepiece

    path = common.tokenizer_path(piece_bpe.MODEL)
    lib, m = sentencepiece.SentencePieceProcessor(model_file=path), token_count.machine(path)
    texts = ["a" * 3000, ("x" * 17 + "b") * 300, "".join(rng.choice("abcdefghij") for _ in range(5000)), text(900).replace(" ", ""), "日本語" * 900, " " * 3000, "ab" * 600 + " " + "cd" * 900, "-" * 2111, ("q" * 700 + " ") * 5]
    assert m.counts(texts).tolist() == [len(lib.encode(t)) for t in texts]
    for _ in range(30):  # the scan against step by step
        n, width = rng.randint(1, 20), rng.randint(1, 4)
        nxt = np.array([[rng.randint(-1, width - 1) for _ in range(width)] for _ in range(n)])
        head = np.array([True, *(rng.random() < 0.3 for _ in range(n - 1))])
        want = np.empty_like(nxt)
        for k in range(n):
            for c in range(width):
                if head[k]:
                    want[k, c] = nxt[k, c]
                else:
                    want[k, c] = nxt[k, want[k - 1, c]] if want[k - 1, c] >= 0 else -1
        assert (token_count.scanned(nxt, head) == want).all()


def test_text_without_spaces_takes_no_longer():
    import time

    m = token_count.machine(common.tokenizer_path(piece_bpe.MODEL))
    spaced = text(16_000)[:80_000]
    took = []
    for t in (spaced, spaced.replace(" ", "x")):
        m.counts([t])
        took.append(min(_timed(time, lambda t=t: m.counts([t])) for _ in range(3)))
    assert took[1] < 10 * took[0] + 0.1


def _timed(time, f):
    began = time.time()
    f()
    return time.time() - began


# ---------------------------------------------------------------- long texts
def test_long_texts_in_bounded_steps():
    """20 MB in one row: the arrays of a step do not grow with it."""
    part = (text(2000) + "\n").encode()
    n = (20 << 20) // len(part) + 1
    data = np.frombuffer(part * n, np.uint8)
    offs = np.array([0, len(data)])
    w = decontaminate.Words(data, offs)
    assert len(w.starts) == n * len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.decode().lower()))
    assert len(common._powers[0]) <= common.STEP + 2
    base = quality_rules.base_counts(data, offs)
    assert base["n_words"][0] == n * 2000 and base["n_repeat_words"][0] == n * 2000 and base["n_dup_lines"][0] == n - 1
    s, starts, ends = ctw.stream(data, offs, 6)
    assert sum(len(g) for g, _ in ctw.grams(s, starts, ends, 6)) == ends[0] - starts[0]
    assert quality_features.dots(data, offs, np.ones(1 << quality_features.BITS, np.float32))[0] > 1
    assert simhash.fingerprint(part * 20) == simhash.fingerprint(part * 20)
    assert token_count.machine(common.tokenizer_path(piece_bpe.MODEL)).counts([part.decode() * 40])[0] > 0


def test_index_of_a_benchmark_is_small():
    items = [(str(k), text(400)) for k in range(300)] + [("letters", "a b c d e f g h i j " * 2000)]
    index = decontaminate.Index(items)
    assert index.nbytes() <= 10 * sum(len(t.encode()) for _, t in items)
