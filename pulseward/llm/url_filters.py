"""URL filters: pattern rules fetched by their rarest literal token.

A rule is a pattern on a URL's host and path. Up to its first ``/`` it names a host and fits that host and all its
subdomains; what follows is the start of the path. ``*`` stands for any characters, ``^`` for one character that is
neither an ASCII letter nor a digit, or for an end of the URL.

A token is a run of ASCII letters and digits. Every token that a pattern encloses on both sides must stand in a URL that
fits; the one that the fewest URLs hold is the rule's key in the index. A URL fetches the rules under its own tokens,
and only those run their regular expression. Rules that enclose no token are under the empty token, which every URL has.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import staged

#: Rows of a hot token are spread over so many groups where the index is too large for every task.
SALTS = 16
#: Verdict on a URL that no rule fits.
DEFAULT = "allow"


def lowered(text: Column) -> Column:
    """A to Z only, so that no other character turns into a token's."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased; path: from there up to ``?``, ``#`` or the end.

    Both are empty where the URL is null or has no ``://``.
    """
    rest = F.when(F.instr(url, "://") > 0, F.element_at(F.split(url, "://", 2), 2)).otherwise("")
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def compiled(rules: DataFrame) -> DataFrame:
    """``rules`` (pattern, action, rank) with the regular expression and the enclosed tokens of each pattern.

    Rules without a pattern or an action are dropped; repeats count once; a null rank is 0.
    """
    literal = F.regexp_replace("pattern", r"([\x21-\x29\x2b-\x2f\x3a-\x40\x5b-\x5d\x5f\x60\x7b-\x7e])", r"\\$1")
    wild = F.replace(F.replace(literal, F.lit("^"), F.lit("(?:[^A-Za-z0-9]|^|$)")), F.lit("*"), F.lit(".*"))
    known = rules.select("pattern", "action", F.coalesce(F.col("rank").cast("int"), F.lit(0)).alias("rank"))
    return known.where("pattern is not null and action is not null").distinct().select(
        "pattern",
        "action",
        "rank",
        F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), wild).alias("regex"),
        F.regexp_extract_all(lowered(F.col("pattern")), F.lit(r"(?<![a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])"), F.lit(0)).alias("tokens"),
    )


def index_rules(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, pattern, action, rank, regex): each rule under its token that the fewest of all ``urls`` (tokens) hold."""
    spelled = staged(
        compiled(rules).select("pattern", "action", "rank", "regex", F.explode_outer(F.array_distinct("tokens")).alias("token")), "url-rules"
    )
    held = urls.select(F.explode("tokens").alias("token")).join(spelled.select("token").distinct(), "token", "left_semi")
    counts = held.groupBy("token").agg(F.count("*").alias("n"))
    rare = F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("token", F.lit("")).alias("token"))
    keyed = spelled.join(counts, "token", "left").groupBy("pattern", "action", "rank", "regex").agg(F.min(rare).alias("key"))
    return keyed.select(F.col("key.token").alias("token"), "pattern", "action", "rank", "regex")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: its id, ``host, path, pattern, rank, verdict, fetched, fitted``.

    Of the rules that fit, the highest rank decides, then the longest pattern, then ``block`` before ``allow``, then the
    pattern that sorts last; ``pattern`` and ``rank`` are its own. Where none fits they are null and the verdict is DEFAULT;
    so it is for a null URL and one without ``://``, whose host and path are empty. ``fetched`` counts the rules whose
    expression ran, ``fitted`` those that fit. Repeated rows are judged each; other columns are ignored.

    All rows of a URL are made in one task, so they are one row each before the exchange; the index is a written table of known size,
    which the planner sends to every task if it is small and joins by token and salt if not.
    """
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).select(
        F.monotonically_increasing_id().alias("row"),
        "page_id",
        "host",
        "path",
        F.array_distinct(F.regexp_extract_all(lowered(F.concat("host", "path")), F.lit("[a-z0-9]+"), F.lit(0))).alias("tokens"),
    )
    index = staged(index_rules(rules, urls), "url-index")
    salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = urls.select(
        "row",
        "page_id",
        "host",
        "path",
        F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"),
        F.explode(F.concat(F.array(F.lit("")), "tokens")).alias("token"),
    )
    fits = F.regexp_like(F.concat("host", "path"), F.col("regex"))
    rank = F.struct("rank", F.length("pattern").alias("size"), (F.col("action") == "block").alias("blocks"), "pattern", "action")
    found = (
        asked.join(salted, ["token", "salt"], "left")
        .withColumn("fits", fits)
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max(F.when(F.col("fits"), rank)).alias("best"), F.count("regex").alias("fetched"), F.count_if(F.col("fits")).alias("fitted"))
    )
    return found.select(
        F.col("page_id").alias(id_col),
        "host",
        "path",
        "best.pattern",
        "best.rank",
        F.coalesce("best.action", F.lit(DEFAULT)).alias("verdict"),
        "fetched",
        "fitted",
    )
