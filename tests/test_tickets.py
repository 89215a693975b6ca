import re
from datetime import date, datetime

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseward.functions import embedding
from pulseward.functions.embedding import embed_with, hash_embed, hash_embed_text, sparse_embed
from pulseward.functions.vectors import cosine_to, vector_normalize
from pulseward.operators import lexical, nearest
from pulseward.operators import tickets as t
from pulseward.schemas import TICKETS


@pytest.fixture(scope="module")
def store(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        vector = None if i % 17 == 0 else [float(v) for v in rng.normal(size=8)]
        if i % 50 == 1:
            vector = [0.0] * 8
        rows.append(
            (
                i,
                "A" if i % 3 else "B",
                datetime(2026, 1, 1 + i % 28, 6),
                ["N", "S", "E"][i % 3 if i < 200 else 0],
                f"Prod {i % 4}",
                "Retail" if i % 2 else "Enterprise",
                f"C{i}",
                "cat",
                "NORMAL",
                0.0,
                0.0,
                f"s{i}",
                f"m{i}",
                vector,
            )
        )
    return spark.createDataFrame(rows, TICKETS).cache()


def cosine(a, b):
    a, b = np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=float)
    size = np.linalg.norm(a) * np.linalg.norm(b) if len(a) == len(b) else 0
    return float(a @ b / size) if size else None


def test_topk_equals_brute_force(spark, store):
    query = [1.0, -0.5, 0.25, 0.0, 2.0, -1.0, 0.5, 0.1]
    got = [(r.ticket_id, r.similarity_score) for r in t.ticket_topk(store, query, 7, 0.1).collect()]
    assert t.ticket_topk(store, query, 300, 0.1).count() == sum(1 for r in store.collect() if r.embedding and (cosine(r.embedding, query) or 0) >= 0.1)
    scored = [(r.ticket_id, cosine(r.embedding, query)) for r in store.collect() if r.embedding]
    want = sorted([s for s in scored if s[1] is not None and s[1] >= 0.1], key=lambda s: (-s[1], s[0]))[:7]
    assert sorted(got) == sorted((i, round(s, 6)) for i, s in want)


def test_scores_just_below_a_threshold_stay_out(spark, store):
    c = 0.3999996
    rows = [(i, [x, (1 - x * x) ** 0.5]) for i, x in ((1, c), (2, 0.4000003), (3, 0.4000001))]
    df = spark.createDataFrame(rows, "ticket_id bigint, embedding array<float>")
    assert [r.ticket_id for r in t.ticket_topk(df, [1.0, 0.0], 5, 0.4).orderBy("ticket_id").collect()] == [2, 3]
    assert [r.ticket_id for r in t.ticket_topk(df, [1.0, 0.0], 1, 0.4).collect()] == [2]


def test_zero_and_mismatched_vectors_have_no_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0],), (None,), ([1.0, 1.0],)], "v array<float>")
    got = [r[0] for r in df.select(cosine_to(F.col("v"), [1.0, 0.0])).collect()]
    assert got[:3] == [None, None, None] and abs(got[3] - 0.5**0.5) < 1e-7


def part_of(label, wanted):
    """Whether a label has the wish in it; wildcards as in LIKE."""
    if not wanted or not wanted.strip():
        return True
    body = "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in wanted.strip())
    return label is not None and re.search(body, label, re.I | re.S) is not None


def brute(queries, rows, k, strict_min, broad_min):
    out = set()
    for q in queries:
        mine = [r for r in rows if r.embedding and (q["dataset_source"] is None or r.dataset_source == q["dataset_source"])]
        scored = [(r, cosine(r.embedding, q["query_vector"])) for r in mine] if q["query_vector"] else []
        scored = [(r, round(s, 12)) for r, s in scored if s is not None]
        strict = [
            (r, s)
            for r, s in scored
            if s >= strict_min
            and (not q["region"] or r.region == q["region"])
            and part_of(r.product_name, q["product_name"])
            and part_of(r.customer_tier, q["customer_tier"])
        ]
        chosen = strict or [(r, s) for r, s in scored if s >= broad_min]
        for rank, (r, s) in enumerate(sorted(chosen, key=lambda p: (-p[1], p[0].ticket_id))[:k], 1):
            out.add((q["query_id"], rank, not strict, r.ticket_id, round(s, 9)))
    return out


ASKED = "query_id bigint, dataset_source string, region string, product_name string, customer_tier string, query_vector array<double>"


def asked_of(rng, n, width):
    return [
        {
            "query_id": i,
            "dataset_source": [None, "A", "B"][i % 3] if i % 5 else "A",
            "region": ["N", "S", "E", "X", None, ""][i % 6],
            "product_name": ["prod 1", "PROD_2", "%3", "none", None, " ", "a\\b"][i % 7],
            "customer_tier": ["retail", None, "ENTER"][i % 3],
            "query_vector": None if i % 19 == 18 else [0.0] * width if i % 23 == 22 else [float(v) for v in rng.normal(size=width)],
        }
        for i in range(n)
    ]


def matches(spark, asked, tickets, *limits, counts=None):
    queries = spark.createDataFrame([tuple(q.values()) for q in asked], ASKED)
    found = nearest.nearest_tickets(queries, tickets, *limits, counts=counts).collect()
    return {(r.query_id, r.rank, r.is_fallback, r.ticket_id, round(r.similarity_score, 9)) for r in found}


@pytest.mark.parametrize("together", [4096, 10])
def test_nearest_tickets_equal_brute_force(spark, store, together, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_TICKETS", together)
    monkeypatch.setattr(nearest, "FEWEST_TICKETS", 40)
    asked = asked_of(np.random.default_rng(5), 60, 8)
    odd = [(900, None, None, None, None, [1.0] * 8), (901, "A", None, "Prod 1", None, [1.0] * 8), (902, "A", "N", "Prod 1", "Retail", [1.0] * 3)]
    more = spark.createDataFrame(odd, "ticket_id bigint, dataset_source string, region string, product_name string, customer_tier string, embedding array<float>")
    rows = store.select(*nearest.TICKET_FIELDS).unionByName(more).repartition(6)
    got = matches(spark, asked, rows, 4, 0.3, 0.2)
    assert got == brute(asked, rows.collect(), 4, 0.3, 0.2) and {g[2] for g in got} == {True, False}
    assert matches(spark, asked, rows.limit(0), 4, 0.3, 0.2) == set()


def test_nearest_tickets_skip_clusters_that_cannot_reach_the_best(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    vectors = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 24)) * 0.15
    vectors[:2000] = vectors[0]  # a third of all tickets are the same
    rows = [(i, "A", "N" if i % 3 else "S", "P", "T", v.tolist()) for i, v in enumerate(vectors)]
    tickets = spark.createDataFrame(rows, "ticket_id bigint, dataset_source string, region string, product_name string, customer_tier string, embedding array<float>")
    asked = [
        {"query_id": i, "dataset_source": "A", "region": None if i % 2 else "S", "product_name": None, "customer_tier": None,
         "query_vector": (centres[i % 30] + rng.normal(size=24) * 0.15).tolist()}
        for i in range(40)
    ]
    sc = spark.sparkContext
    counts = sc.accumulator(0), sc.accumulator(0)
    got = matches(spark, asked, tickets, 5, 0.3, 0.2, counts=counts)
    assert got == brute(asked, tickets.collect(), 5, 0.3, 0.2)
    allowed = sum(6000 if q["region"] is None else 2000 for q in asked)
    print("share of tickets not compared:", 1 - counts[0].value / allowed)
    assert counts[0].value < 0.4 * allowed and counts[1].value > 0


def test_filters(spark, store):
    assert t.filter_tickets(store, product_name=" prod 1 ").count() == 75
    assert t.filter_tickets(store, product_name="PROD_2").count() == 75
    # both bounds mean midnight: tickets at six on the last day are out
    days = {r.ticket_created_at.date() for r in t.filter_tickets(store, start_date=date(2026, 1, 3), end_date=date(2026, 1, 5)).collect()}
    assert days == {date(2026, 1, 3), date(2026, 1, 4)}


def test_normalised_vectors_have_length_one_or_zero(spark, store):
    rows = store.select("embedding", vector_normalize(F.col("embedding"), 5).alias("cut"), vector_normalize(F.col("embedding"), 12).alias("pad")).collect()
    for r in rows:
        if r.embedding is None:
            assert r.cut is None and r.pad is None
            continue
        for v, n in ((r.cut, 5), (r.pad, 12)):
            assert len(v) == n
            size = np.linalg.norm(v)
            assert abs(size - 1) < 1e-6 or size == 0
        assert not any(r.pad[8:])


def test_lexical_search_finds_shared_words(spark):
    rows = [
        (1, "Corporate card 3DS OTP timeout", "The 3DS mobile OTP timeout error stopped our transaction"),
        (2, "FX fee", "A foreign exchange fee was added to my statement"),
    ]
    blank = [(3, "blank card", " \n"), (4, "null card", None), (5, None, None)]
    df = t.embed_tickets(spark.createDataFrame(rows + blank, "ticket_id bigint, subject string, message string"))
    assert {r.ticket_id for r in t.search_tickets(df, "card", limit=9, min_similarity=0.3).collect()} == {3, 4}
    best = t.search_tickets(df, "3DS mobile OTP timeout error during transaction", limit=1, min_similarity=0.3).first()
    assert best.ticket_id == 1
    assert t.search_tickets(df, "   ").count() == 0
    assert t.search_tickets(df.limit(0), "otp").count() == 0
    assert not any(hash_embed_text("  "))


def test_embeddings_are_deterministic_and_pluggable(spark):
    df = spark.createDataFrame([("One two",), (None,)], "s string")
    a, b = (sorted(map(str, df.select(hash_embed(F.col("s"))).collect())) for _ in range(2))
    assert a == b

    def load():
        return lambda texts: np.array([[len(x), 1.0] for x in texts])

    assert [list(r[0]) for r in df.select(embed_with(load, F.col("s"))).collect()] == [[7.0, 1.0], [0.0, 1.0]]


def test_defaults_and_citations(spark):
    df = spark.createDataFrame([(5, None, "hello")], "ticket_id bigint, region string, message string")
    row = t.ticket_defaults(df, "D", datetime(2026, 1, 1)).first()
    assert (row.region, row.product_name, row.customer_id, row.priority, row.dispute_amount) == ("West", "General", "CUST-UNKNOWN", "NORMAL", 0.0)
    cited = t.citations(t.ticket_defaults(df, "D", datetime(2026, 1, 1)).withColumn("similarity_score", F.lit(0.123456))).first()
    assert tuple(cited) == (5, "CUST-UNKNOWN", "General", ": hello", 0.1235)


def messages(seed, n):
    rng = np.random.default_rng(seed)
    words = np.array([f"word{i}" for i in range(400)] + ["Ünï", "né2", "x_y", "don't", "漢字"])
    share = 1 / np.arange(1, len(words) + 1)
    return [" ".join(rng.choice(words, rng.integers(0, 30), p=share / share.sum())) for _ in range(n)]


def test_sparse_vectors_equal_the_dense_ones_without_python(spark):
    texts = [*messages(1, 200), None, "", "  ", "one", "One one TWO", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", sparse_embed(F.col("s")).alias("p"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for row in df.collect():
        want = np.array(hash_embed_text(texts[row.i] or ""), np.float32)
        assert row.p["indices"] == np.flatnonzero(want).tolist() and row.p["values"] == want[want != 0].tolist()


def test_an_index_embeds_every_text_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 50)
    monkeypatch.setattr(embedding, "COUNTED_TEXTS", 7, raising=False)
    texts = [*messages(3, 200), None, "", "  ", "One one TWO", "x_y İ ΣΑΣ ǅ ½ Ⅷ e\u0301", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id bigint, message string").repartition(3)
    index = lexical.lexical_index(df)
    # Neither the sizes nor the blocks make words of the texts again.
    assert "regexp_extract_all" not in index._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(tuple(r) for r in index.select("bucket", F.explode("postings").alias("p")).select("p.ticket_id", "bucket", "p.weight").collect())
    want = []
    for r in df.select("ticket_id", sparse_embed(F.trim("message")).alias("v")).collect():
        values = np.array(r.v["values"], np.float32).astype(float)
        length = np.sqrt(np.cumsum(values * values)[-1:])  # added one by one, as Spark does
        want += [(r.ticket_id, b, w) for b, w in zip(r.v["indices"], (values / length).tolist())]
    assert got == sorted(want) and len(got) > 1000


def postings_of(vectors):
    """(ticket_id, bucket, weight) of sparse vectors, whose squares are added one by one, as Spark does."""
    out = []
    for r in vectors.collect():
        values = np.array(r.v["values"], np.float32).astype(float)
        out += [(r.ticket_id, b, w) for b, w in zip(r.v["indices"], (values / np.sqrt(np.cumsum(values * values)[-1:])).tolist())]
    return sorted(out, key=repr)


def test_an_index_deals_slices_of_postings(spark):
    texts = [*messages(4, 3000), None, " "]
    df = spark.createDataFrame([(None if i == 7 else f"t{i // 2}", m) for i, m in enumerate(texts)], "ticket_id string, message string")
    index = lexical.lexical_index(df.repartition(2))
    each = index.select("bucket", "level", "top", F.explode("postings").alias("p")).select("*", "p.ticket_id", "p.weight")
    got = [(r.ticket_id, r.bucket, r.weight) for r in each.collect()]
    assert sorted(got, key=repr) == postings_of(df.select("ticket_id", sparse_embed(F.trim("message")).alias("v")))
    assert each.where("weight > top or level != ceil(weight * 32)").count() == 0
    # What is stored and then dealt to the blocks is not a row per posting.
    assert spark.read.parquet(*index.inputFiles()).count() < len(got) / 5


def test_an_index_has_the_words_of_spark_whatever_the_characters(spark):
    """Two texts of each 64 code points: between letters, and apart."""
    known = [i for i in range(1, 0x110000) if not 0xD800 <= i < 0xE000]
    runs = [[chr(i) for i in known[at : at + 64]] for at in range(0, len(known), 64)]
    texts = [f"x{'x x'.join(r)}x" for r in runs] + [" ".join(r) for r in runs]
    df = spark.createDataFrame(list(enumerate(texts)), "ticket_id bigint, message string").repartition(4)
    index = lexical.lexical_index(df).select("bucket", F.explode("postings").alias("p")).select("p.ticket_id", "bucket", "p.weight")
    assert sorted(map(tuple, index.collect()), key=repr) == postings_of(df.select("ticket_id", sparse_embed(t.ticket_text(df)).alias("v")))


def test_texts_are_counted_in_parts_of_bounded_size(monkeypatch):
    monkeypatch.setattr(embedding, "COUNTED_WORDS", 100)
    monkeypatch.setattr(embedding, "TEXT_WORDS", 10)
    words = [["a"] * 30, [], ["b", "c"] * 500, *[["c"]] * 30, [], ["漢", "a", "漢"]]
    batch = pa.RecordBatch.from_pydict({"ticket_id": pa.array(range(len(words))), "words": pa.array(words)})
    parts = list(embedding.counted_parts(batch))
    assert pa.Table.from_batches(parts).to_pydict() == {"ticket_id": list(range(len(words))), "words": words}
    assert len(parts) > 4 and all(sum(len(w) + 10 for w in p["words"].to_pylist()[1:]) < 100 for p in parts)
    whole = embedding.bucket_weights(batch["words"])
    split = [embedding.bucket_weights(p["words"]) for p in parts]
    assert all([x for s in split for x in s[i].tolist()] == whole[i].tolist() for i in (1, 2))
    assert not len(embedding.bucket_weights(pa.array([[], []], pa.list_(pa.string())))[0])


def test_search_by_blocks_equals_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 50)
    texts = messages(2, 600)
    texts[5:9] = [texts[4]] * 4
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)] + [(900, "word3 word300", None)], "ticket_id bigint, subject string, message string")
    lexical.lexical_index(df).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    vectors = {i: np.array(hash_embed_text(t), np.float32).astype(float) for i, t in [*enumerate(texts), (900, "word3 word300")]}
    for query, limit, least in ((texts[4], 7, 0.2), ("word300 word301 word7", 3, 0.3), ("word1", 700, 0.0), ("Ünï x_y", 5, 0.1), ("absent", 5, 0.1)):
        q = np.array(hash_embed_text(query))
        scored = [(i, float(v @ q / np.linalg.norm(v))) for i, v in vectors.items() if v @ q > 0]
        want = sorted([(i, s) for i, s in scored if round(s, 12) >= least], key=lambda x: (-round(x[1], 12), x[0]))[:limit]
        got = [(r.ticket_id, r.similarity_score) for r in lexical.search_index(index, query, limit, least).collect()]
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    assert lexical.search_index(index, "  ", 5, 0.1).count() == 0
    needed = lexical.candidate_blocks(index, lexical.query_weights("word0 word1 word300 word301"), 0.9)
    assert 0 < needed.count() < index.count() / 5
    assert "PushedFilters: [IsNotNull(top)" in needed._jdf.queryExecution().executedPlan().toString()
    assert max(r.n for r in index.select(F.size("postings").alias("n")).collect()) < 120
