"""Table functions for SQL: url_matches over a table with a text column."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .text import BARE_URL, SCHEME_URL, TLDS


def _pattern(p: str) -> re.Pattern:
    r"""A pattern of this library for Python: \x{2028} is spelt \u2028 there; case is ASCII's, word bounds are Unicode's."""
    return re.compile(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", p).replace(r"\b", r"(?u:\b)"), re.ASCII)


class UrlMatches:
    """SELECT * FROM url_matches(TABLE(lines), 'line_text', false): every row of the table for each match in its text,
    with match_no, start_off and value; bare domains with known ends if the last argument is true, else URLs with a
    scheme.  Null texts have no matches.  The same rows as operators.candidates gives."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, column: AnalyzeArgument, bare: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or column.value not in rows.dataType.fieldNames():
            raise ValueError("url_matches takes a table, the name of one of its text columns, and whether bare domains are meant")
        out = StructType(list(rows.dataType.fields)).add("match_no", IntegerType()).add("start_off", IntegerType()).add("value", StringType())
        return AnalyzeResult(schema=out)

    def eval(self, row, column: str, bare: bool):
        text, n = row[column], 0
        for m in _pattern(BARE_URL if bare else SCHEME_URL).finditer(text) if text else ():
            if not bare or m[0].partition("/")[0].rpartition(".")[2].lower() in TLDS:
                yield (*row, n, m.start(), m[0])
            n += 1


def register(spark: SparkSession) -> None:
    """Makes url_matches known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("url_matches", udtf(UrlMatches))
