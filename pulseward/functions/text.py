"""Text columns: names, ids, report text, JSON found in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r\f\x0b"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def dataset_slug(file_name: Column) -> Column:
    """Partition name for a file: extension off, other characters to one underscore, lower case."""
    base = strip(F.regexp_replace(file_name, r"\.[^.]+$", ""))
    slug = F.lower(F.btrim(F.regexp_replace(base, "[^a-zA-Z0-9_]+", "_"), F.lit("_")))
    return F.when(slug == "", "custom_dataset").otherwise(slug)


def customer_id(entity_id: Column) -> Column:
    """For display only: different ids can share it."""
    return F.concat(F.lit("CUST-"), F.right(entity_id, F.lit(6)))


def metric_title(metric: Column) -> Column:
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def signed_percent(value: Column) -> Column:
    """One decimal with an explicit sign, as ``+12.3%``."""
    return F.format_string("%+.1f%%", value)


def text_lines(items: Column, default: str = "") -> Column:
    """A list of texts as lines; missing or empty lists give the default."""
    return F.when(F.size(items) > 0, F.array_join(items, "\n")).otherwise(F.lit(default))


def text_pairs(entries: Column, default: str = "") -> Column:
    """A list of maps as lines of ``key: value`` pairs."""
    lines = F.transform(
        entries,
        lambda m: F.array_join(
            F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; "
        ),
    )
    return text_lines(lines, default)


def text_object(value: Column, default: str = "") -> Column:
    """A map or struct as JSON text."""
    return F.coalesce(F.to_json(value), F.lit(default))


def text_or_default(text: Column, default: str) -> Column:
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, text).otherwise(F.lit(default))


def json_body(raw: Column) -> Column:
    """The outermost braces of a text that may wrap its JSON in a fence or in prose."""
    text = strip(raw)
    text = F.when(text.startswith("```json"), F.substr(text, F.lit(8))).when(
        text.startswith("```"), F.substr(text, F.lit(4))
    ).otherwise(text)
    text = strip(F.when(F.endswith(text, F.lit("```")), F.left(text, F.length(text) - 3)).otherwise(text))
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(braces != "", braces).otherwise(text)


def parsed_json(raw: Column) -> Column:
    """The JSON found in a text as a variant; null where it does not parse."""
    return F.try_parse_json(json_body(raw))
