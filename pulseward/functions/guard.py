"""Read-only check of ad-hoc SQL, for one text or a column of texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseward.functions.text import BLANKS, strip

# Words that mark a statement as not read-only.
FORBIDDEN_WORDS = [
    "INSERT",
    "UPDATE",
    "DELETE",
    "DROP",
    "ALTER",
    "TRUNCATE",
    "GRANT",
    "REVOKE",
    "CREATE",
    "EXEC",
    "EXECUTE",
    "CALL",
    "MERGE",
]

# Functions through which a plain SELECT could reach arbitrary JVM code.
ESCAPE_FUNCTIONS = ["reflect", "try_reflect", "java_method"]


class UnsafeQuery(ValueError):
    """The text is not a single read-only query."""


def check_query(sql: str) -> str:
    """The query without its closing semicolon, or ``UnsafeQuery``."""
    text = sql.strip(BLANKS)
    text = text[:-1].strip(BLANKS) if text.endswith(";") else text
    if ";" in text:
        raise UnsafeQuery("more than one statement")
    for word in FORBIDDEN_WORDS + ESCAPE_FUNCTIONS:
        if re.search(rf"\b{word}\b", text, re.IGNORECASE):
            raise UnsafeQuery(f"{word} is not allowed in a read-only query")
    if not re.match(r"(SELECT|WITH)\b", text, re.IGNORECASE):
        raise UnsafeQuery("a query starts with SELECT or WITH")
    return text


def cleaned_query(sql: Column) -> Column:
    text = strip(sql)
    return strip(F.when(F.endswith(text, F.lit(";")), F.left(text, F.length(text) - 1)).otherwise(text))


def query_verdict(sql: Column) -> Column:
    """``OK``, or why a text is refused: the first forbidden word, ``MULTIPLE`` or ``NOT_SELECT``."""
    text = cleaned_query(sql)
    verdict = F.when(text.rlike(r"(?i)^(SELECT|WITH)\b"), "OK").otherwise("NOT_SELECT")
    for word in reversed(FORBIDDEN_WORDS + ESCAPE_FUNCTIONS):
        verdict = F.when(text.rlike(rf"(?i)\b{word}\b"), word.upper()).otherwise(verdict)
    return F.when(F.contains(text, F.lit(";")), "MULTIPLE").otherwise(verdict)
