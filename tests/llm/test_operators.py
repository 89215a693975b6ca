"""Each operator against a plain Python version, and on odd rows: nulls, empty and long texts, repeats, clashing columns."""

import hashlib
import zlib

import numpy as np
import pytest

from pulseward.llm import (
    exact_dedup,
    fingerprints,
    language_mix,
    license_scan,
    line_chunks,
    minhash,
    mixing,
    packing,
    quality_cnn,
    token_rollups,
)
from pulseward.llm.tokens import default_files, encoder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, copy int, key long, score double"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    base = prose(1, 120)
    edited = " ".join(["changed", *base.split()[1:]])
    far = prose(2, 120)
    rows = [
        (5, base), (3, base.replace(" ", " \n\t ")), (5, base), (7, edited), (8, far), (9, None), (10, ""), (11, " \n "),
        (None, far), (12, "two words"), (13, prose(3, 30_000)), (14, None), (15, "ünïcödé <|endoftext|> x  y \n z"),
    ]
    data = [(i, t, None if k % 3 else "xx", None if k % 4 else "s", 1, "r", 1, 2, 0.5) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).coalesce(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    results = [
        minhash.near_duplicates(empty), line_chunks.drop_repeats(empty), license_scan.scan(empty),
        language_mix.identify(empty, language_mix.fit(empty)), fingerprints.compare_with_edits(empty),
        mixing.mix_sources(empty), packing.pack(empty), quality_cnn.score(empty, quality_cnn.fit(empty, labels)),
        exact_dedup.dedup(empty),
    ]
    assert [r.count() for r in results] == [0] * len(results)


@pytest.mark.parametrize("fan", [2, 4])
def test_exact_dedup(odd, fan):
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(odd, fan=fan).collect()}
    assert {(5, 3, 3, False), (3, 3, 3, True), (9, 9, 3, True), (10, 9, 3, False), (14, 9, 3, False)} <= found
    assert {(8, 8, 2, True), (None, 8, 2, False), (11, 11, 1, True)} <= found
    kept = exact_dedup.kept_documents(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 8, 9, 11, 12, 13, 15]


def test_near_duplicates(odd):
    rows = minhash.near_duplicates(odd).collect()
    classes = {(r.doc_id, r.class_id) for r in rows}
    assert {(5, 3), (7, 3), (3, 3), (8, 8), (None, 8), (9, 9), (10, 9), (11, 9), (12, 12), (13, 13)} <= classes
    assert sorted(r.doc_id for r in minhash.kept_documents(odd).collect()) == [3, 8, 9, 12, 13, 15]
    assert len(rows) == odd.count()


def test_near_duplicates_that_only_members_link(spark):
    for seed in range(100):
        common, shared, left, right = (prose(10 * seed + k, n).split() for k, n in enumerate((60, 25, 5, 5)))
        texts = [" ".join(x) for x in (common, common + shared + left, common + shared + right)]
        grams, owner, _ = minhash.shingles(texts, 1)
        grams, owner, _ = minhash.distinct(grams, owner)
        if len(set(minhash.dart_signatures(grams, np.ones(len(grams)), owner, 3, 1)[:, 0].tolist())) == 1:
            break
    # One bucket of three; its pivot, the text without words of its own, is near neither of the two that are near each other.
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.near_duplicates(docs, bands=1, rows=1, words=1).collect()
    assert {(r.doc_id, r.class_id, r.class_size) for r in rows} == {(0, 0, 1), (1, 1, 2), (2, 1, 2)}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 2**63, 300).astype(np.uint64)
    left, right = rng.integers(0, 5, 300) * 1.0, rng.integers(0, 5, 300) * 1.0
    right[:200] = left[:200]
    want = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    a, b = left > 0, right > 0
    sets = np.concatenate((elements[a], elements[b]))
    owner = np.repeat([0, 1], [a.sum(), b.sum()])
    got = minhash.dart_signatures(sets, np.concatenate((left[a], right[b])), owner, 2, 2000)
    assert abs((got[0] == got[1]).mean() - want) < 0.04


def test_line_chunks_remove_later_passages_only(spark):
    passage = "\n".join(prose(100 + i, 8) for i in range(40))
    rows = [(1, prose(1, 9) + "\n" + passage), (2, passage + "\n" + prose(2, 9)), (3, prose(3, 9)), (4, None)]
    got = {r.doc_id: r for r in line_chunks.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[3].text == rows[2][1] and got[4].text is None
    assert got[2].removed_lines >= 20 and got[2].text.endswith(rows[1][1].split("\n")[-1])
    assert got[2].n_lines - got[2].removed_lines == len(got[2].text.split("\n"))


def plain_line_chunks(rows):
    """Removed lines (from 0) of each row, in the given order, by the stated rule."""
    seen, out = {}, []
    for number, (_, text) in enumerate(rows):
        lines = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        found = set()
        for multiplier in line_chunks.MULTIPLIERS:
            start = 0
            for i in range(len(lines)):
                if i == len(lines) - 1 or (i and (31 * h[i - 1] + h[i]) * multiplier % line_chunks.PRIME % 2 == 0):
                    found.add((start, i + 1))
                    start = i + 1
        gone = set()
        for a, b in sorted(found):
            body = "\n".join(lines[a:b])
            if b - a > 1 and body.replace("\n", "").strip(" "):
                gone |= set(range(a, b)) if body in seen else set()
                seen[body] = number
        out.append(gone)
    return out


@pytest.mark.parametrize("n", [2, 3, 4, 5, 8])
def test_line_chunks_find_short_passages(spark, n):
    rows = []
    for i in range(60):
        passage = [prose(1000 * n + 10 * i + k, 12) for k in range(n)]
        for side in (0, 1):
            around = [prose(50_000 + 10 * i + 4 * side + k, 9) for k in range(4)]
            rows.append((2 * i + side, "\n".join(around[:2] + passage + around[2:])))
    got = {r.doc_id: r for r in line_chunks.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        lines = text.split("\n")
        left = got[i].text.split("\n")
        assert left[:2] == lines[:2] and left[-2:] == lines[-2:] and got[i].n_lines == n + 4
        assert i % 2 or got[i].text == text
    removed = sum(got[i].removed_lines for i, _ in rows if i % 2)
    assert removed >= {2: 0.7, 3: 0.85}.get(n, 0.9) * 60 * n


def test_line_chunks_need_a_chunk_that_stood_before(spark):
    lines = [[prose(100 * i + k, 6) for k in range(3)] for i in range(40)]
    rows = [(3 * i + k, "\n".join(t)) for i, (x, y, z) in enumerate(lines) for k, t in enumerate(((x, y), (y, z), (x, y, z)))]
    got = {r.doc_id: r.text for r in line_chunks.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in rows if i % 3 < 2)
    assert {got[3 * i + 2] for i in range(40)} <= {t for x, y, z in lines for t in ("\n".join((x, y, z)), z)}


def test_line_chunks_lose_no_line(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i if i < 59 else None, "\n".join(rng.choice(["a", "b", "c", "d", "", " "], rng.integers(1, 12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = line_chunks.drop_repeats(docs).collect()
    full = {x for _, t in rows for x in t.split("\n") if x.strip()}
    assert {x for r in got for x in r.text.split("\n") if x.strip()} == full
    want = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)) for (i, t), gone in zip(rows, plain_line_chunks(rows))]
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.text) for r in got), key=repr)


def test_line_chunks_compare_bytes(spark):
    rows = [(1, "a\nb", 7), (2, "c\nd", 7), (3, "a\nb", 7), (None, "c\nd", 7), (4, "e\nf", 8), (5, "e\nf", 8)]
    mark = "array<struct<at: int, size: int, hash: bigint, later: boolean>>"
    moved = spark.createDataFrame([(i, t, i, [(1, 2, h, i not in (1, 4))]) for i, t, h in rows], f"doc_id long, text string, __key long, __marks {mark}")
    assert {r.doc_id for r in line_chunks.with_equal_bytes(moved).collect()} == {3, None, 5}


def test_line_chunks_of_odd_rows(odd):
    clashing = odd.withColumnRenamed("key", "removed_lines").withColumnRenamed("copy", "hash").withColumnRenamed("row", "at")
    rows = line_chunks.drop_repeats(clashing).collect()
    assert len(rows) == odd.count() and {r.text for r in rows if r.doc_id in (9, 14)} == {None}
    assert [r.n_lines for r in rows if r.doc_id == 10] == [1]


def test_licenses(spark):
    text = prose(1, 40) + "\nReleased under the MIT License.\n" + prose(2, 40)
    altered = license_scan.TEMPLATES["BSD-2-Clause"].replace("source code", "source texts")
    rows = [(1, text), (2, altered), (3, prose(3, 50)), (4, None), (5, "the license of a driver is on the table")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == "MIT-notice" and got[1].exact and text[got[1].start :].startswith("Released")
    assert got[2].license == "BSD-2-Clause" and got[2].confirmed and not got[2].exact
    assert set(got) == {1, 2, 5} and not got[5].confirmed


def test_licenses_near_each_other_and_in_long_lines():
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    gpl, mit, isc = (license_scan.TEMPLATES[n] for n in ("GPL-3.0-or-later", "MIT", "ISC"))
    dual = f"{gpl} {prose(7, 5)}\n{mit}\n{isc} {isc}"
    got = scanner.notices(dual)
    assert [r["license"] for r in got if r["confirmed"]] == ["GPL-3.0-or-later", "MIT", "ISC", "ISC"] and len(got) == 4
    assert [dual[r["start"] :][: r["n_chars"]] for r in got] == [gpl, mit, isc, isc] and all(r["exact"] for r in got)
    edited = gpl.replace("program", "library").replace("modify", "change").replace("published", "printed")
    line = f"{prose(8, 300)} the license of it {edited} of the {prose(9, 300)}"
    (found,) = [r for r in scanner.notices(line) if r["confirmed"]]
    assert found["license"] == "GPL-3.0-or-later" and found["words_missing"] == 3
    assert found["start"] == line.index(edited) and line[found["start"] :][: found["n_chars"]] == edited
    (rest,) = [r for r in scanner.notices(line) if not r["confirmed"]]
    assert rest["start"] == 0 and line[: rest["n_chars"]].endswith("of it ")
    apache = license_scan.TEMPLATES["Apache-2.0"].replace("compliance", "accord").replace("limitations", "limits")
    assert [r["license"] for r in scanner.notices(apache)] == ["Apache-2.0"]


def test_licenses_are_ranked_by_bytes_saved(monkeypatch):
    scanner = license_scan.Scanner(license_scan.TEMPLATES)
    text = license_scan.TEMPLATES["CC-BY-SA-4.0-notice"]
    order = scanner.ranked(text)
    data = text.encode()
    assert len(order) == len(scanner.names) and order[0][1] == "CC-BY-SA-4.0-notice"
    assert [n for n, _ in order] == sorted((len(scanner.plain.compress(data)) - len(scanner.given[n].compress(data)) for n in scanner.names), reverse=True)
    asked = []
    passage = scanner.passage
    monkeypatch.setattr(scanner, "passage", lambda own, name: asked.append(name) or passage(own, name))
    (row,) = scanner.notices(text)
    # CC-BY-4.0 would be confirmed as well, one word being extra; the template that saves most is looked at first and wins.
    assert asked == ["CC-BY-SA-4.0-notice"] and row["license"] == asked[0] and row["exact"]
    assert scanner.confirms(*passage(license_scan.words(text), "CC-BY-4.0-notice")[:3])


def plain_notices(scanner, block):
    """Winners of a block by the stated rule, without the bound on words and on text rather than places."""
    out, todo = [], [block]
    while todo:
        piece = todo.pop()
        if not license_scan._CUE.search(piece):
            continue
        for _, name in scanner.ranked(piece):
            found = scanner.passage(license_scan.words(piece), name)
            if found and scanner.confirms(*found[:3]):
                places = [m.span() for m in license_scan._WORD.finditer(piece)]
                a, b = places[found[3]][0], places[found[4] - 1][1]
                out.append((name, piece[a:b]))
                todo += [piece[:a], piece[b:]]
                break
    return sorted(out)


def test_licenses_against_a_plain_scan(spark, odd, empty):
    rng = np.random.default_rng(9)
    scanner, names = license_scan.Scanner(license_scan.TEMPLATES), sorted(license_scan.TEMPLATES)
    rows = []
    for i in range(30):
        pieces = []
        for name in rng.choice(names, rng.integers(1, 4)):
            words = license_scan.TEMPLATES[name].split(" ")
            for k in rng.integers(0, len(words), len(words) // 25):
                words[k] = "changed"
            pieces += [prose(100 * i + len(pieces), int(rng.integers(1, 30))), " ".join(words)]
        rows.append((i, "\n".join(pieces)))
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("confirmed").collect()
    for i, text in rows:
        want = sorted(x for a, b in license_scan.candidate_blocks(text) for x in plain_notices(scanner, text[a:b]))
        found = sorted((r.license, text[r.start :][: r.n_chars].rstrip(".,;:!?)\"'")) for r in got if r.doc_id == i)
        assert found == [(n, t.rstrip(".,;:!?)\"'")) for n, t in want]
    assert license_scan.scan(odd).count() == license_scan.scan(empty).count() == 0


def test_language_mixtures(spark):
    english = "the quick brown fox jumps over the lazy dog and then runs through the forest with other animals "
    german = "der schnelle braune fuchs springt über den faulen hund und läuft danach durch den wald mit anderen tieren "
    rows = [(i, (english if i % 2 else german) * 3, "en" if i % 2 else "de") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mix.fit(docs)
    asked = spark.createDataFrame([(1, english * 4 + german * 4), (2, german), (3, None), (4, "12 + 3"), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in language_mix.identify(asked, model).collect()}
    assert sorted(got[1].languages) == ["de", "en"] and got[2].languages == ["de"]
    assert [got[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and 0 <= got[1].score <= 1


def test_fingerprints_follow_descending_ids(odd):
    rows = fingerprints.compare_with_edits(odd).collect()
    texts = [(r.doc_id, r.text or "") for r in odd.collect() if r.doc_id and r.doc_id > 8]
    ordered = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in rows}
    for (i, text), (_, following) in zip(ordered, ordered[1:]):
        third = len(text) // 3
        want = text[: len(text) - third] + following[:third]
        assert got[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest() and got[i].n_chars == len(text)
    assert len(rows) == odd.count() and len({r.fingerprint for r in rows if r.doc_id == 5}) == 1
    a, b = (fingerprints.sketches([t])[0] for t in (prose(1, 300), prose(1, 900)))
    both = a.merged(b)
    assert both.text() == both.merged(b).text() == b.merged(both).text() == fingerprints.Sketch.parse(both.text()).text()
    assert a.containment(both) == 1 == both.likeness(both.merged(a)) and both.likeness(a) == a.likeness(both) < 0.5
    assert a.containment(b) > 0.95 and fingerprints.Sketch.parse(a.text()).likeness(a) == 1


def test_mixing_meets_weights(spark):
    docs = spark.range(6000).selectExpr("id doc_id", "'xxxxxxxxxx' text", "if(id % 3 = 0, 'a', 'b') source", "1 copies")
    got = mixing.mix_sources(docs, {"a": 0.75, "b": 0.25})
    counts = {r["source"]: r["count"] for r in got.groupBy("source").count().collect()}
    assert abs(counts["a"] - 4500) < 300 and abs(counts["b"] - 1500) < 200
    large = mixing.copies(docs.limit(50), {"a": 1.0})
    assert large.where("source = 'b' and copies > 0").count() == 0


def test_packing(odd):
    rows = packing.pack(odd, with_ids=True).collect()
    encode = encoder(*default_files()).encode
    want = sorted(encode(r.text or "") + b"\x02\0\0\0" for r in odd.collect())
    by_doc = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(r.doc_id, []).append(r)
    whole = b"".join(bytes(r.ids) for r in sorted(by_doc[13], key=lambda r: r.piece))
    assert whole in want and len(by_doc[13]) == -(-len(whole) // 4096)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= -(-sum(r.length for r in rows) // 1024) + 1


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    files = default_files()
    full, fast = Tokenizer.from_file(files[0]), encoder(*files)
    for text in ["", " ", "a  b", "a \n b", "a\n\n b  ", "x's we'll 12,5 €  ü　ñ 漢字", "a \n  b", "<|endoftext|> b", "\ta \t b", "é e a  b"]:
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text
        assert fast.count(text) == len(fast.encode(text)) // 4


def test_ids_are_those_of_the_tokenizer_on_odd_strings_and_documents(spark):
    from tokenizers import Tokenizer

    files = default_files()
    full, fast = Tokenizer.from_file(files[0]), encoder(*files)
    rng = np.random.default_rng(12)
    marks = np.array(list(" \n\t\r  　a9_'.,é漢ß€") + ["  ", "'s", " the", "<|endoftext|>", "\u0301", "\U0001f600"])
    texts = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(4000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, want in zip(texts, full.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == want.ids and fast.count(text) == len(want.ids), repr(text)


CHANGE = "op string, doc_id long, source string, lang string, text string"


def test_rollups_are_idempotent(spark, tmp_path):
    rollup = token_rollups.Rollup(spark, str(tmp_path / "rollup"))
    first = [("upsert", 1, "a", "en", "one two"), ("upsert", 2, "a", "en", "three"), ("upsert", 3, None, "de", None), ("upsert", None, "a", "en", "x")]
    assert rollup.commit(1, spark.createDataFrame(first, CHANGE))
    second = spark.createDataFrame([("upsert", 1, "b", "en", "one"), ("delete", 2, None, None, None), ("delete", 9, None, None, None)], CHANGE)
    assert rollup.commit(2, second) and not rollup.commit(2, second)
    got = {(r.source, r.lang): (r.documents, r.chars, r.tokens) for r in rollup.totals().collect()}
    assert got == {("b", "en"): (1, 3, 1), (None, "de"): (1, 0, 0)}
    with pytest.raises(ValueError):
        rollup.commit(1, second.limit(0)) or token_rollups.Rollup(spark, rollup.path, "other").commit(1, second)


def test_rollups_of_several_versions(spark, tmp_path):
    old, new = (token_rollups.Rollup(spark, str(tmp_path / "rollup"), v) for v in ("v1", "v2/é"))
    frame = lambda *rows: spark.createDataFrame(list(rows), CHANGE)
    both = frame(("upsert", 1, "a", "en", "one two"), ("upsert", 2, "a", "en", "three"))
    assert old.commit(1, both) and new.commit(1, both) and not new.commit(1, both)
    totals = lambda: {(r.tokenizer, r.source): (r.documents, r.chars) for r in new.totals().collect()}
    assert totals() == {("v1", "a"): (2, 12), ("v2/é", "a"): (2, 12)}
    assert new.commit(2, frame(("upsert", 2, "b", "en", "four")))
    assert totals() == {("v1", "a"): (2, 12), ("v2/é", "a"): (1, 7), ("v2/é", "b"): (1, 4)}
    assert new.commit(3, frame(("delete", 1, None, None, None)))
    assert totals() == {("v1", "a"): (1, 5), ("v2/é", "b"): (1, 4)}
    assert old.commit(3, frame(("delete", 1, None, None, None), ("upsert", 1, "c", "en", "lost")))
    assert totals() == {("v1", "a"): (1, 5), ("v2/é", "b"): (1, 4)}


def test_rollups_over_many_batches_and_odd_rows(spark, tmp_path, monkeypatch, odd, empty):
    monkeypatch.setattr(token_rollups, "SNAPSHOT_EVERY", 3)
    rollup = token_rollups.Rollup(spark, str(tmp_path / "rollup"))
    rng, held = np.random.default_rng(3), {}
    for batch in range(8):
        rows = {int(i): ("delete" if rng.random() < 0.3 else "upsert", int(i), str(rng.integers(3)), "en", "x" * int(rng.integers(9))) for i in rng.integers(0, 12, 5)}
        rollup.commit(batch, spark.createDataFrame(list(rows.values()), CHANGE))
        for op, i, source, _, text in rows.values():
            held.pop(i, None)
            if op == "upsert":
                held[i] = source, len(text)
    want = {s: (sum(1 for a, _ in held.values() if a == s), sum(n for a, n in held.values() if a == s)) for s, _ in held.values()}
    assert {r.source: (r.documents, r.chars) for r in rollup.totals().collect()} == want
    assert len(rollup._done("snapshots")) == 2
    from pyspark.sql import functions as F

    odd_rollup = token_rollups.Rollup(spark, str(tmp_path / "odd"))
    assert odd_rollup.commit(0, empty.withColumn("op", F.lit("upsert"))) and odd_rollup.totals().count() == 0
    assert odd_rollup.commit(1, odd.withColumn("op", F.lit("upsert")).withColumn("tokenizer", F.lit("mine")).withColumn("place", F.lit(9)))
    rows = {r.doc_id: max([t.text or "" for t in odd.collect() if t.doc_id == r.doc_id], key=len) for r in odd.collect() if r.doc_id}
    assert sum(r.documents for r in odd_rollup.totals().collect()) == len(rows)
    assert sum(r.chars for r in odd_rollup.totals().collect()) == sum(map(len, rows.values()))


def test_quality_network_learns(spark):
    rows = [(i, prose(i, 40) + ("" if i % 2 else "!!! ###" * 3), i % 2) for i in range(400)] + [(900, None, None), (901, "", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows], "doc_id long, quality int, toxic int")
    model = quality_cnn.fit(docs, labels)
    got = {r.doc_id: r for r in quality_cnn.score(docs, model).collect()}
    held = [i for i, _, _ in rows[:400] if got[i].held_out]
    assert np.mean([got[i].predicted == i % 2 for i in held]) > 0.95 and got[900].score == got[901].score
    assert quality_cnn.accepted(docs, model).columns == docs.columns
