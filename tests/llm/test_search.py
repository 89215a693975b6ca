"""URL filters, lexical search and whitening against plain versions, and on odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from pulseward.llm import bidiagonal, lexical_search, url_filters, whitening

RULES = [
    ("com/", "allow", 1), ("example.com/en/", "block", 1), ("www.example.com/en/", "allow", 1), ("net/es/", "block", 1),
    ("*^casino^", "block", 0), ("*lot*tery", "block", 0), ("*^pills^", "allow", 0), ("*^pills^", "block", 0),
    ("shop.org/a.b(c)/*/x", "block", 2), (None, "block", 0), ("gone.org/", None, 0), ("com/", "allow", 1),
]
URLS = [
    "http://example.com/en/1", "https://WWW.Example.com/en/x", "http://a.www.example.com/en/", "http://example.com/EN/", "x://example.com",
    "http://notexample.com/en/", "http://x.net/es/1?q", "http://x.net/es", "http://casino.org", "http://my-casino.org/a", "http://casinos.org/a",
    "http://a.org/lot-of-pottery/lottery", "http://a.org/buy/pills", "http://shop.org/a.b(c)/mid/x1", "http://shop.org/aXb(c)/mid/x1",
    "no scheme", "", None, "://", "a://b://c/d", "http://x.com?casino", "http://x.org#casino", "http://ünï.com/é", "http://x.org/" + "a/" * 20_000 + "casino",
]


def plain_verdict(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    hits = []
    for pattern, action, rank in set(RULES):
        if pattern is None or action is None:
            continue
        body = "".join(".*" if c == "*" else "(?:[^A-Za-z0-9]|^|$)" if c == "^" else re.escape(c) for c in pattern)
        if re.match(r"(?:[^/]*\.)?" + body, host + path, re.S):
            hits.append((rank, len(pattern), action == "block", pattern, action))
    best = max(hits, default=(None, None, None, None, "allow"))
    return host, path, best[3], best[4], len(hits)


def test_url_filters(spark):
    rules = spark.createDataFrame(RULES, "pattern string, action string, rank int")
    rows = [(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], None, None), (None, URLS[1], None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, token string, salt string").repartition(3)
    got = url_filters.judge(pages, rules).collect()
    want = Counter((i, *plain_verdict(u)) for i, u, _, _ in rows)
    assert Counter((r.page_id, r.host, r.path, r.pattern, r.verdict, r.fitted) for r in got) == want
    assert max(r.fetched for r in got) < 8
    assert url_filters.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_url_rules_are_kept_under_their_rarest_token(spark):
    rules = spark.createDataFrame([("a.example.com/en/", "block", 0), ("*x", "block", 0)], "pattern string, action string, rank int")
    urls = spark.createDataFrame([(["example", "com", "en"],), (["example", "com", "a"],), (["a", "example"],)], "tokens array<string>")
    assert {(r.pattern, r.token) for r in url_filters.index_rules(rules, urls).collect()} == {("a.example.com/en/", "en"), ("*x", "")}


def plain_search(docs, items, limit=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    counted = [(i, Counter(split(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, length = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    out, asked = [], {}
    for item, text in items:
        asked.setdefault(item, set()).update(split(text))
    for item, words in asked.items():
        scores = []
        for doc_id, c in counted:
            m = 10 + (90 * sum(c.values()) * n) // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1_000_000_000 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, s[3], -s[0]) for k, s in enumerate(sorted(scores)[:limit])]
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array(["w%d" % i for i in range(300)] + ["Ünder", "né9", "X_y", "a-b"])
    share = 1 / np.arange(1, len(words) + 1)
    return [(int(i), " ".join(rng.choice(words, rng.integers(1, 60), p=share / share.sum()))) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_lexical_search(spark, monkeypatch, block):
    from pulseward.llm import common

    docs = corpus(1, 400) + [(1000 + i, "same w250 text w251") for i in range(30)] + [(None, "w250"), (7, "w250 twice"), (2000, None), (2001, ""), (2002, "-- ;")]
    docs.append((3000, "w1 " * 40_000 + "w260"))
    items = corpus(2, 25) + [(50, None), (51, "unknown"), (52, "w250 W251"), (52, "w260"), (None, "w3 w200"), (53, "w260 w260 a_b")]
    frame = spark.createDataFrame([(i, t, 1, "c") for i, t in docs], "doc_id long, text string, rank int, block string").repartition(3)
    if block != common.BLOCK_CHARS:
        source = common.blocks.__globals__
        monkeypatch.setitem(source, "BLOCK_CHARS", block)
        frame = frame.repartition(40)  # small blocks by partition: the workers do not see the patch
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    got = sorted(tuple(r) for r in lexical_search.search(frame, asked).fillna(-1, ["item_id", "doc_id"]).collect())
    want = sorted((-1 if a is None else a, b, -1 if c is None else c, d) for a, b, c, d in plain_search(docs, items))
    assert got == want


def test_lexical_search_in_batches_and_on_empty_tables(spark, monkeypatch):
    docs, items = corpus(3, 100), corpus(4, 12)
    frame, asked = (spark.createDataFrame(x, f"{n} long, text string") for x, n in ((docs, "doc_id"), (items, "item_id")))
    monkeypatch.setattr(lexical_search, "BATCH_TERMS", 60)
    assert sorted(tuple(r) for r in lexical_search.search(frame, asked, 3).collect()) == sorted(plain_search(docs, items, 3))
    assert lexical_search.search(frame.limit(0), asked).count() == 0
    assert lexical_search.search(frame, asked.limit(0)).count() == 0


def test_lexical_search_drops_accumulators_on_the_way():
    items = [[np.array([0])], [np.array([1])]]
    weight = np.array([1000, 10])
    step = lexical_search.stage_step(0, items, weight, np.zeros(1, np.int64), 2)
    import pandas as pd

    one = {"block": 0, "doc_ids": np.arange(6), "lengths": np.full(6, 100), "bounds": np.array([10**9, 10**4]), "items": [], "docs": [], "scores": []}
    left = pd.DataFrame([one])
    right = pd.DataFrame([{"block": 0, "terms": [0], "counts": [4], "docs": [0, 1, 2, 3], "tfs": [9, 9, 1, 1]}])
    out = step(left, right).iloc[0]
    assert out["docs"].tolist() == [0, 1] and (out["scores"] > 0).all()


@pytest.mark.parametrize("case", ["random", "graded", "orthogonal", "deficient", "identity", "zero", "one"])
def test_qd_solver(case):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(40, 40))
    if case == "graded":
        a = a * np.logspace(0, -8, 40)
    if case == "deficient":
        a[:, 9:] = 0
    a = {"orthogonal": np.linalg.qr(a)[0], "identity": np.eye(40), "zero": np.zeros((40, 40)), "one": a[:1, :1]}.get(case, a)
    squares, v = bidiagonal.right_singular(a)
    top = max(1e-300, squares.max())
    assert np.abs(np.sqrt(np.maximum(squares, 0)) - np.linalg.svd(a)[1]).max() <= 1e-13 * math.sqrt(top)
    assert np.abs(v.T @ v - np.eye(len(a))).max() < 1e-12
    assert np.abs(a.T @ a @ v - v * squares).max() <= 1e-13 * top


def plain_whitening(vectors):
    x = np.floor(64 * np.array(vectors, np.float64)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    y = (fit * n - sums) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return x, n, sums, e[::-1], v[:, ::-1]


def test_whitening(spark):
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(300, 20)).astype(np.float32) * np.linspace(0.2, 3, 20).astype(np.float32)
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(vectors)] + [(900 + i, vectors[0].tolist(), 1.0) for i in range(200)]
    odd = [(800, None, 1.0), (801, [None] + [0.0] * 19, 1.0), (802, [float("nan")] * 20, 1.0), (803, [float("inf")] * 20, 1.0), (804, [0.5] * 7, 1.0), (805, [], 1.0), (None, vectors[1].tolist(), None)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, whitened double").repartition(13)
    got = whitening.whiten(frame).collect()
    x, n, sums, e, v = plain_whitening([r[1] for r in rows])
    assert len(got) == (len(rows) + 1) * 16 and {r.n for r in got} == {n}
    at = {r[0]: i for i, r in enumerate(rows)} | {None: 1}
    signs = {}
    for r in got:
        y = [int(a) * n - int(s) for a, s in zip(x[at[r.vec_id]], sums)]
        assert r.deviation == sum(d * d for d in y)
        want = np.array(y) / n @ v[:, r.component - 1] / math.sqrt(e[r.component - 1])
        if abs(want) > 1e-6:
            assert signs.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(want) - abs(r.whitened)) < 1e-9
        assert abs(r.explained - e[r.component - 1] / e.sum()) < 1e-12 and r.identity_error < 1e-10


def test_whitening_of_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).count() == 0
    got = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, abs(round(r.whitened, 9))) for r in got) == [(1, 1, 1.0), (2, 1, 1.0)]


def test_whitening_centres_exactly_beyond_longs():
    x = np.array([[2**40, 5], [1, 2]])
    n, sums = 10**9, [7 * 10**20, 3]
    assert whitening.centred(x, n, sums).tolist() == [[2**40 * n - sums[0], 5 * n - 3], [n - sums[0], 2 * n - 3]]
