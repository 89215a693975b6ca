"""Line dedup by content-defined chunks (DataFrame operations only).

Several rolling hashes run over the line hashes of a text, each over a window of two lines and under a seed of its own. A line
ends a chunk of a seed where that seed's hash is divisible by MODULUS, so the cuts inside a passage are the same wherever
the passage stands, whatever lines come before it. Under several seeds a passage is cut in several ways, of which
some also begin and end with it.

A chunk of two lines or more, of any seed, that stands earlier in the corpus goes. Chunks meet by a hash of their line hashes;
of those that occur more than once the bytes are compared, and a hash that stands for several texts is replaced by the text.
The earliest place of a line has no earlier chunk, so every line stays somewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import staged

#: Rolling hashes, and the share of lines (one in so many) after which each of them cuts.
SEEDS, MODULUS = 16, 2
#: Factor between the two lines of a window, and modulus (a prime) and multipliers of the seeds.
BASE, PRIME = 31, 1_073_741_789
MULTIPLIERS = [pow(48_271, s + 1, PRIME) for s in range(SEEDS)]
#: Bits per document with a mark, and the least and most bits, of the map by which texts without marks stay in place.
BITS_PER_MARK, FEWEST_BITS, MOST_BITS = 16, 1 << 20, 1 << 30


def lined(docs: DataFrame) -> DataFrame:
    """``doc_id, key`` (hash of the text) and ``lines``; null texts are empty, which is one empty line."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("key"), F.split(text, "\n").alias("lines"))


def spans(rolled: Column, lines: Column) -> Column:
    """Distinct chunks (``at``, from 1, and ``size``) of two lines or more, of all seeds.

    ``rolled`` has the hash of each window of two lines; the last line ends a chunk of every seed.
    """

    def of_seed(multiplier: int) -> Column:
        cut = lambda x, i: F.when((x * F.lit(multiplier) % PRIME) % MODULUS == 0, i + 2)
        ends = F.array_append(F.filter(F.transform(rolled, cut), lambda x: x.isNotNull() & (x < F.size(lines))), F.size(lines))
        starts = F.array_prepend(F.transform(ends, lambda x: x + 1), F.lit(1))
        pairs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("size")))
        return F.filter(pairs, lambda p: p["size"] > 1)

    return F.array_distinct(F.flatten(F.array(*[of_seed(m) for m in MULTIPLIERS])))


def chunks(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, at, size, hash): chunks with something in them, by their first line (from 1) and number of lines."""
    number = lambda line: F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")
    hashed = lined(docs).select(
        "doc_id",
        "key",
        "lines",
        F.transform("lines", number).alias("numbers"),
        F.transform("lines", lambda line: F.xxhash64(line)).alias("hashes"),
        F.transform("lines", lambda line: F.trim(line) == "").alias("blank"),
    )
    rolled = F.zip_with("numbers", F.slice("numbers", 2, F.greatest(F.size("numbers") - 1, F.lit(0))), lambda a, b: a * BASE + b)
    each = hashed.select(
        "doc_id", "key", "hashes", "blank", F.filter(rolled, lambda x: x.isNotNull()).alias("rolled"), "lines"
    ).select("doc_id", "key", "hashes", "blank", F.explode_outer(spans(F.col("rolled"), F.col("lines"))).alias("span"))
    part = lambda name: F.slice(name, F.col("span.at"), F.col("span.size"))
    return each.where(F.col("span.at").isNotNull() & F.exists(part("blank"), lambda b: ~b)).select(
        "doc_id", "key", "span.at", "span.size", F.xxhash64(part("hashes")).alias("hash")
    )


def _bits(marked: DataFrame) -> tuple[DataFrame, int]:
    """A map of the documents of ``marked`` (doc_id, key): bytes by bucket, at most MOST_BITS in all."""
    bits = FEWEST_BITS
    while bits < min(MOST_BITS, BITS_PER_MARK * marked.count()):
        bits *= 2
    place = _place(bits)
    return marked.groupBy(F.bitmap_bucket_number(place).alias("__bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("__map")
    ), bits


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "key"), F.lit(bits)) + 1


def marked_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without a repeated chunk, other rows with ``__marks``: at, size, hash and later of their repeated chunks, or null).

    The first occurrence, by ``doc_id`` (null last) and place in the document, is the only one that is not ``later``. Rows that
    share id and text are one document; rows that share only the id come in the order of a hash of their texts. Only rows
    of the second kind move. Rows have ``__key``.
    """
    found = staged(chunks(docs), "chunks")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    ends = found.groupBy("hash").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first <> last")
    firsts = ends.select("hash", "first")
    repeated = found.join(firsts.hint("shuffle_merge"), "hash").select("doc_id", "key", F.struct("at", "size", "hash", (order != F.col("first")).alias("later")).alias("mark"))
    marks = staged(repeated.groupBy("doc_id", "key").agg(F.collect_set("mark").alias("marks")), "marks")
    maps, bits = _bits(marks.select("doc_id", "key"))
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__key", F.xxhash64(text))
    place = F.pmod(F.xxhash64("doc_id", "__key"), F.lit(bits)) + 1
    looked = keyed.withColumn("__bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "__bucket", "left")
    position = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.col("__map").substr((F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("shiftright", byte, (position % 8).cast("int")) % 2 != 0, F.lit(False))
    looked = looked.withColumn("__hit", hit).drop("__bucket", "__map")
    right = marks.select(F.col("doc_id").alias("__id"), F.col("key").alias("__want"), F.col("marks").alias("__marks"))
    left = looked.where("__hit").drop("__hit")
    same = left["doc_id"].eqNullSafe(right["__id"]) & (left["__key"] == right["__want"])
    moved = left.join(right.hint("shuffle_merge"), same, "left").drop("__id", "__want")
    return looked.where("not __hit").drop("__hit"), moved


def with_equal_bytes(moved: DataFrame) -> DataFrame:
    """(doc_id, key, at, size) of the marks to remove: later occurrences whose bytes are those of an earlier one.

    Copies of a chunk meet in the map tasks first. Only a hash that several texts share needs its texts' first places.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    body = F.array_join(F.slice(F.split(text, "\n"), F.col("m.at"), F.col("m.size")), "\n")
    each = moved.select("doc_id", F.col("__key").alias("key"), "text", F.explode("__marks").alias("m")).select(
        "doc_id", "key", "m.at", "m.size", "m.hash", "m.later", body.alias("body")
    )
    texts = each.groupBy("hash", "body").agg(F.lit(1).alias("texts"))
    unclear = staged(texts.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "unclear")
    plain = each.drop("body").where("later").join(unclear, "hash", "left_anti").select("doc_id", "key", "at", "size")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "at")
    shared = each.join(unclear, "hash")
    first = shared.groupBy("hash", "body").agg(F.min(order).alias("first"))
    return plain.union(shared.join(first, ["hash", "body"]).where(order != F.col("first")).select("doc_id", "key", "at", "size"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with ``text`` less its repeated chunks, and ``removed_chunks`` (runs of lines), ``removed_lines``, ``n_lines``.

    The rest keeps its order, joined by line breaks. A text without lines left is empty; a null text stays null and counts as
    one empty line. Chunks of blank lines stay. Columns of the input with the added names are replaced; other columns stay.
    """
    added = ("removed_chunks", "removed_lines", "n_lines")
    columns = [c for c in docs.columns if c not in added]
    still, moved = marked_documents(docs.select(*columns))
    moved = staged(moved, "marked")
    gone = with_equal_bytes(moved).select("doc_id", "key", F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("line"))
    lines = gone.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set("line")).alias("__gone"))
    right = lines.select(F.col("doc_id").alias("__id"), F.col("key").alias("__want"), "__gone")
    left = moved.drop("__marks")
    changed = left.join(right.hint("shuffle_merge"), left["doc_id"].eqNullSafe(right["__id"]) & (left["__key"] == right["__want"]), "left")
    text = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    kept = F.array_except(F.sequence(F.lit(1), F.size(text)), F.col("__gone"))
    rest = F.array_join(F.transform(kept, lambda i: F.element_at(text, i)), "\n")
    clean = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(rest)
    number = lambda items: F.coalesce(F.when(items.isNotNull(), F.size(items)), F.lit(0)).cast("long")
    runs = F.array_except("__gone", F.transform("__gone", lambda i: i + 1))
    whole = still.withColumn("__gone", F.lit(None).cast("array<int>")).unionByName(changed.drop("__id", "__want"))
    return whole.select(
        *[clean.alias("text") if c == "text" else F.col(c) for c in columns],
        F.size(text).cast("long").alias("n_lines"),
        number(runs).alias("removed_chunks"),
        number(F.col("__gone")).alias("removed_lines"),
    )
