"""A table function for SQL: the spans of a text as rows, ``SELECT * FROM t, LATERAL pii_spans(t.text)``.

For DataFrames ``explode(regex_spans(...))`` does the same in the JVM; this one is for plain SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from maskwright.functions.patterns import COMBINED, GROUPS, LUHN_GROUP

#: The JVM's expression, which stays linear on long runs, with its meaning of white space, for an engine that knows \\G.
SCAN = COMBINED.removeprefix("(?U)").replace(r"\s", r"\p{White_Space}")


def luhn(value: str) -> bool:
    digits = [int(c) for c in value if c in "0123456789"][::-1]
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
    return 13 <= len(digits) <= 19 and total % 10 == 0


class PiiSpans:
    def __init__(self):
        import regex

        self.scan = regex.compile(SCAN, regex.V0)

    def eval(self, text: str) -> Iterator[tuple[str, int, int, str, float]]:
        at = end = 0  # bytes and characters so far
        for m in self.scan.finditer(text or ""):
            at += len(text[end : m.start()].encode())
            size, end = len(m[0].encode()), m.end()
            if m.lastindex != LUHN_GROUP or luhn(m[0]):
                yield GROUPS[m.lastindex - 1][0], at, at + size, m[0], 1.0
            at += size


def register(spark: SparkSession, name: str = "pii_spans") -> None:
    """Make the table function known to the session's SQL."""
    spark.udtf.register(name, udtf(PiiSpans, returnType="category string, start int, end int, text string, score float"))
