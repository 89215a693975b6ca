"""Operators without SQL, and the whole pipeline, against plain versions on small tables."""

import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from pulseward.llm import fingerprints, language_mix, minhash, packing, quality_cnn
from pulseward.llm.tokens import default_files, encoder

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_counts(text, words=5):
    tokens = re.split("[ \t-\r]+", (text or "").lower())
    tokens = [t for t in tokens if t]
    grams = [tuple(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or ([tuple(tokens)] if tokens else [])
    return Counter(grams)


def plain_classes(rows, similarity=0.8, weighted=False):
    """Smallest id of the class of each (id, text), by all pairs."""
    sets = [shingle_counts(t) for _, t in rows]
    if not weighted:
        sets = [Counter(dict.fromkeys(s, 1)) for s in sets]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both, either = (sets[i] & sets[j]).total(), (sets[i] | sets[j]).total()
        if (either and both >= similarity * either) or not either:
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), math.inf), math.inf if doc_id is None else doc_id)
    return [least[root(i)] for i in range(len(rows))]


def edited_rows(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    for k, (_, text) in enumerate(rows[:60]):
        words = (text or "").split(" ")
        for at in rng.integers(0, len(words), max(0, len(words) // [400, 60, 30, 12][k % 4])):
            words[at] = "edited"
        rows.append((10_000 + k, " ".join(words)))
    rows += [(20_000, "w " * 300), (20_001, "w " * 200), (20_002, "w " * 310), (20_003, None), (20_004, " \n")]
    return rows


@pytest.mark.parametrize("weighted", [False, True])
def test_near_duplicates_equal_all_pairs(spark, weighted):
    rows = edited_rows(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs, weighted=weighted).collect()}
    want = {i: c for (i, _), c in zip(rows, plain_classes(rows, weighted=weighted))}
    assert got == want and len(set(want.values())) < len(rows) - 20


def plain_mixture(model, text):
    """Proportions of the selected languages by loops over single trigrams."""
    letters = [c if c.isalpha() else " " for c in (text or "").lower()]
    runs = "".join(letters).split()
    grams, _ = language_mix.trigrams([text])
    assert len(grams) == sum(map(len, runs))
    if not len(grams):
        return {}
    table = np.exp(model.log_p.astype(float))
    rows = [table[g] for g in grams]
    n = len(model.languages)

    def em(share, steps):
        for _ in range(steps):
            total = np.zeros(n)
            for row in rows:
                joint = row * share
                total += joint / joint.sum()
            share = total / len(rows)
        return share, sum(math.log((row * share).sum()) for row in rows)

    full, _ = em(np.full(n, 1 / n), language_mix.STEPS)
    order = np.argsort(-full, kind="stable")
    single = [sum(math.log(row[k]) for row in rows) for k in range(n)]
    best, level = np.eye(n)[int(np.argmax(single))], max(single) - language_mix.PENALTY * math.log(len(rows))
    for size in range(2, n + 1):
        share = np.zeros(n)
        share[order[:size]] = np.maximum(full[order[:size]], 1e-3)
        share, value = em(share / share.sum(), language_mix.SET_STEPS)
        value -= language_mix.PENALTY * size * math.log(len(rows))
        if value <= level:
            break
        best, level = share, value
    return {model.languages[k]: best[k] for k in np.flatnonzero(best)}


def test_language_mixtures_equal_plain_expectation_maximisation(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language_mix.fit(docs)
    rows = docs.orderBy("doc_id").limit(25).collect()
    texts = [(r.text or "")[:400] for r in rows]
    texts += [a + " " + b for a, b in zip(texts, texts[7:])] + ["", "12 3", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in language_mix.identify(asked, model).collect():
        want = plain_mixture(model, texts[row.doc_id])
        assert dict(zip(row.languages, row.proportions)) == pytest.approx(want, abs=2e-3)
        assert row.lang_pred == (max(want, key=want.get) if want else "und")
    scored = language_mix.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert scored.where("lang_pred = lang").count() >= 0.95 * scored.count() > 20


def test_fingerprints_of_texts_shorter_than_a_shingle():
    texts = [f"{i:x}" for i in range(2000)] + [""]
    found = fingerprints.sketches(texts)
    assert 350 < sum(len(s.hashes) for s in found) < 650 and len({s.text() for s in found}) == len(texts)
    assert all(fingerprints.Sketch.parse(s.text()).text() == s.text() for s in found)


def test_fingerprint_likeness_is_near_the_exact_one(spark):
    rows = [r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()]
    pairs = [(a, fingerprints.edited(a, b)) for a, b in zip(rows, rows[1:])] + list(zip(rows, rows[1:]))
    errors = {"short": [], "long": []}
    for a, b in pairs:
        left, right = fingerprints.sketches([a, b])
        grams = [{t[i : i + fingerprints.SHINGLE] for i in range(len(t) - fingerprints.SHINGLE + 1)} for t in (a, b)]
        if all(grams):
            exact = len(grams[0] & grams[1]) / len(grams[0] | grams[1])
            errors["short" if len(a) < 400 else "long"].append(abs(left.likeness(right) - exact))
            inside = len(grams[0] & grams[1]) / len(grams[0])
            assert len(a) < 400 or abs(left.containment(right) - inside) < 0.2
    print({k: (len(v), np.mean(v), np.quantile(v, 0.99)) for k, v in errors.items()})
    assert np.mean(errors["long"]) < 0.02 and np.mean(errors["short"]) < 0.08


def plain_score(model, text):
    """The network's probability by loops over chunks, windows and filters."""
    w, data = model.weights, (text or "").encode()
    stride, features = quality_cnn.CHUNK - quality_cnn.OVERLAP, []
    for k in range(max(1, -(-(len(data) - quality_cnn.OVERLAP) // stride))):
        chunk = [b + 1 for b in data[k * stride : k * stride + quality_cnn.CHUNK]]
        chunk += [0] * (quality_cnn.CHUNK - len(chunk))
        cells = [np.concatenate([w["embed"][b] for b in chunk[i : i + quality_cnn.STEP]]) for i in range(0, quality_cnn.CHUNK, quality_cnn.STEP)]
        left, right = w["conv"][:, : quality_cnn.FILTERS], w["conv"][:, quality_cnn.FILTERS :]
        top = np.max([a @ left + b @ right for a, b in zip(cells, cells[1:])], axis=0)
        features.append(np.maximum(top + w["bias"], 0))
    hidden = np.maximum(np.mean(features, axis=0) @ w["w1"] + w["b1"], 0)
    return float(1 / (1 + np.exp(-(hidden @ w["w2"] + w["b2"]).item())))


def test_quality_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(4)
    docs = [(quality_cnn.cut([bytes(rng.integers(97, 97 + 10 * (1 + k % 2), 700).astype(np.uint8))])[0].astype("<i2").tobytes(), k % 2) for k in range(40)]
    model = quality_cnn.train(docs, 0.5)
    texts = ["", None, "a", "abc é漢" * 3, "x" * 511, "y" * 512, "zé" * 900, "".join(map(chr, rng.integers(32, 300, 3000)))]
    assert model.score(texts).tolist() == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def normalised(text):
    return re.sub("[ \t-\r]+", " ", text or "")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("pipeline"))
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    extra = [(9000, rows[3][1], None, None, None), (9001, (rows[4][1] or "") + " more", "en", "s", 1), (9002, None, None, "s", 0), (9003, "", "en", None, 0)]
    extra += [rows[5], rows[5], (None, rows[6][1], "en", "s", 1), (None, "a text without an id " * 30, None, None, None), (9004, "long " * 40_000, "en", "s", 9)]
    spark.createDataFrame(rows + extra, SCHEMA).write.parquet(f"{base}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{base}/labels.parquet")
    return base


def test_pipeline_stages_equal_plain_versions(spark, tables):
    docs, steps = spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, tables)
        assert name == "pack_sequences" or made.columns == docs.columns
        steps.append((docs.collect(), made.collect()))
        docs = spark.createDataFrame(steps[-1][1], made.schema)
    rows = lambda found: Counter((r.doc_id, r.text, r.source) for r in found)

    before, after = steps[0]
    model = quality_cnn.fit(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"))
    scores = model.score([r.text for r in before])
    assert rows(after) == rows([r for r, p in zip(before, scores) if p >= 0.5])

    before, after = steps[1]
    first = {}
    for r in before:
        key = normalised(r.text)
        first[key] = min(first.get(key, math.inf), math.inf if r.doc_id is None else r.doc_id)
    assert Counter((normalised(r.text), math.inf if r.doc_id is None else r.doc_id) for r in after) == Counter(first.items())

    before, after = steps[2]
    classes = plain_classes([(r.doc_id, r.text) for r in before])
    assert sorted(math.inf if r.doc_id is None else r.doc_id for r in after) == sorted(set(classes))

    before, after = steps[3]
    chars = Counter()
    for r in before:
        chars[r.source] += len(r.text or "")
    assert set(rows(after)) <= set(rows(before))
    target = {s: math.sqrt(n) / sum(map(math.sqrt, chars.values())) * sum(chars.values()) / n for s, n in chars.items() if n}
    for source, rate in target.items():
        here = [r for r in before if r.source == source]
        expected = rate * len(here)
        assert abs(sum(r.source == source for r in after) - expected) <= 5 * math.sqrt(expected) + 1

    before, after = steps[4]
    encode = encoder(*default_files()).encode
    tokens = Counter()
    for r in before:
        tokens[r.doc_id] += len(encode(r.text or "")) // 4 + 1
    placed, sequences = Counter(), {}
    for r in after:
        placed[r.doc_id] += r.length
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert placed == tokens
    for parts in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 1024
    assert len(sequences) <= 1.05 * sum(tokens.values()) / 1024 + 2


def test_pipeline_runs_on_empty_and_unlabelled_tables(spark, tables, tmp_path):
    empty = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    packed = corpus_pipeline.run(spark, empty)
    assert packed.count() == 0 and packed.columns == packing.pack(spark.read.parquet(f"{empty}/documents.parquet")).columns
    model = quality_cnn.fit(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{empty}/labels.parquet"))
    kept = quality_cnn.accepted(spark.read.parquet(f"{tables}/documents.parquet"), model)
    assert kept.count() == spark.read.parquet(f"{tables}/documents.parquet").count()
