"""Files read in byte ranges against the readers that take them whole."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseward.plans import uploads
from pulseward.sources import files, splits


@pytest.fixture()
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield spark
    for k, v in kept.items():
        spark.conf.set(k, v)


FIELDS = ["plain", "", "a,b", 'say ""hi""', "line\nbreak", "\n\nstart", 'q""', "é漢\r\nx", ",", '""', "x" * 900 + "\n" + "y" * 900, '5" pipe'[:1]]


def quoted(text):
    return f'"{text}"'


def test_csv_with_line_breaks_in_quotes_equals_the_whole_file_reader(small_ranges, tmp_path):
    spark = small_ranges
    rng = np.random.default_rng(1)
    for k in range(3):
        lines = ["id,note,rest"]
        for i in range(300):
            note = FIELDS[rng.integers(len(FIELDS))]
            rest = ["z", "", quoted(FIELDS[rng.integers(len(FIELDS))]), 'in"side', '"tail"']["zabcd".find("zabcd"[rng.integers(5)])]
            lines.append(f"{i},{quoted(note)},{rest}")
        (tmp_path / f"f{k}.csv").write_text("\n".join(lines) + "\n", newline="")
    path = str(tmp_path)
    assert spark.read.text(path).rdd.getNumPartitions() > 50
    want = files.csv_reader(spark, True).csv(path)
    got = splits.csv_records(spark, path)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    assert got.count() == 900


def test_quoted_uploads_are_written_by_many_tasks_and_their_files_read_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(uploads, "FILE_BYTES", 4_000, raising=False)
    spark.range(120).select(F.col("id"), F.concat(F.lit('say "hi",\n'), F.repeat(F.lit("漢\n"), 30), F.col("id").cast("string")).alias("note?")).repartition(
        24
    ).write.parquet(str(tmp_path / "rows"))
    kept = spark.conf.get("spark.sql.files.openCostInBytes"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        df = spark.read.parquet(str(tmp_path / "rows"))
        path = uploads.to_quoted_csv(df)
        sizes = [r.length for r in spark.read.format("binaryFile").load(path).select("length").collect()]
        assert len(sizes) > 2 and min(sizes) > 1500 and max(sizes) < sum(sizes) / 2
        want = [(str(r.id), r["note?"]) for r in df.collect()]
        assert sorted(map(tuple, splits.csv_records(spark, path).collect())) == sorted(want)
        assert spark.read.format("binaryFile").load(uploads.to_quoted_csv(df.where("id < 20"))).count() == 1
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", kept[0])
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept[1])


def test_csv_states_follow_quotes_at_field_starts_only():
    rules = splits.CsvLines()
    state = lambda line, quoted=False: rules.after(splits.State(quoted), line).quoted
    assert [state(x) for x in ('a,"b', 'a,"b"', 'a"b', '5" pipe,"x', '"a""', '"a"",', '""', '"""', 'a, "b', "")] == [
        True, False, False, True, True, True, False, True, False, False,
    ]
    assert [state(x, True) for x in ('b",c', 'b"",c', 'b","c', "b", '"', '""')] == [False, True, True, True, False, True]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_arrays_equal_the_whole_file_reader(small_ranges, tmp_path, indent):
    spark = small_ranges
    rng = np.random.default_rng(2)
    texts = ["x", 'q"', "}", "{[", "\\", '\\"}', "]", "é\n漢", "a" * 1500, ""]
    for k in range(3):
        rows = [
            {"id": 1000 * k + i, "t": texts[rng.integers(len(texts))], "o": {"a": [{"b": texts[rng.integers(len(texts))]}, {}][: rng.integers(3)]}, "n": None if i % 3 else 1.5}
            for i in range(200)
        ]
        (tmp_path / f"f{k}.json").write_text(json.dumps(rows, indent=indent))
    (tmp_path / "none.json").write_text(" [ ]\n")
    path = str(tmp_path)
    want = spark.read.option("multiLine", True).json(path)
    got = files.read_json(spark, path)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 600


def test_json_that_is_no_array_of_records_is_an_error(small_ranges, tmp_path):
    (tmp_path / "f.json").write_text('[1, {"a": 1}]')
    with pytest.raises(Exception, match="not a record"):
        files.read_json(small_ranges, str(tmp_path / "f.json")).collect()
