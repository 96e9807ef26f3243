"""Exports: JSON lines, strict CSV lines, the reader that checks them, and findings about what was written."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

BOM = "﻿"
PLACEHOLDERS = ("undefined", "null", "nan", "[object object]")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line, UTF-8, nulls kept."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def cell(c: str | Column, kind: str = "string") -> Column:
    """A CSV cell: arrays joined by ';', lower-case booleans, blank for null; quoted where a separator, a quote, a line end or an edge space asks for it."""
    x = F.col(c) if isinstance(c, str) else c
    text = F.array_join(x, ";") if kind.startswith("array") else x.cast("string")
    text = F.coalesce(text, F.lit(""))
    return F.when(text.rlike('[",\r\n]|^[ \t]|[ \t]$'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame) -> DataFrame:
    """`line`: each row as an RFC 4180 line without its CRLF."""
    return df.select(F.concat_ws(",", *[cell(f"`{c}`", k) for c, k in df.dtypes]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """Part files of CSV, each with a BOM and the header, lines ended by CRLF. Tasks write their own parts, so size has no bound."""
    header = BOM + ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\r\n') else c for c in df.columns)
    csv_lines(df).withColumnRenamed("line", header).write.option("header", True).option("quote", "").option("emptyValue", "").option("lineSep", "\r\n").option("escapeQuotes", False).option(
        "sep", "\u0001"
    ).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def parse_strict(text: str) -> list[list[str]]:
    """Rows of an RFC 4180 text. A bare CR or LF, a quote inside a plain field and an open quote raise ValueError."""
    rows: list[list[str]] = []
    row: list[str] = []
    at, size = 0, len(text)
    while at < size:
        if text[at] == '"':
            end, parts = at + 1, []
            while True:
                close = text.find('"', end)
                if close < 0:
                    raise ValueError("unterminated quote")
                parts.append(text[end:close])
                if text[close + 1 : close + 2] != '"':
                    break
                end = close + 2
            field, at = '"'.join(parts), close + 1
            if at < size and text[at] not in ",\r\n":
                raise ValueError(f"text after a closing quote at {at}")
        else:
            stop = at
            while stop < size and text[stop] not in ',"\r\n':
                stop += 1
            if text[stop : stop + 1] == '"':
                raise ValueError(f"quote appears mid-field at {stop}")
            field, at = text[at:stop], stop
        row.append(field)
        if at >= size:
            break
        if text[at] == ",":
            at += 1
            if at == size:
                row.append("")
        elif text[at : at + 2] == "\r\n":
            rows.append(row)
            row, at = [], at + 2
        else:
            raise ValueError(f"bare CR or LF outside quotes at {at}")
    return rows + [row] if row else rows


@pandas_udf(StructType([StructField("error", StringType()), StructField("rows", ArrayType(ArrayType(StringType())))]))
def parsed(texts: pd.Series) -> pd.DataFrame:
    """Rows of each whole CSV text without its BOM, or what is wrong with it; null counts as empty."""
    out = []
    for text in texts:
        try:
            out.append((None, parse_strict((text or "").removeprefix(BOM))))
        except ValueError as wrong:
            out.append((str(wrong), None))
    return pd.DataFrame(out, columns=["error", "rows"])


def findings(text: str | Column, got: str | Column, banned: tuple[str, ...] = ()) -> Column:
    """What is wrong with the structure of a whole CSV file, as sorted names of findings; none for a sound file.

    `got` is a column that already holds the text's `parsed` form.
    """
    c, got = (F.col(x) if isinstance(x, str) else x for x in (text, got))
    header = F.coalesce(F.get(got["rows"], F.lit(0)), F.array().cast("array<string>"))
    body = F.slice(got["rows"], 2, F.greatest(F.size(got["rows"]) - 1, F.lit(0)))
    lower = F.transform(header, F.lower)
    checks = {
        "no-bom": ~F.startswith(F.coalesce(c, F.lit("")), F.lit(BOM)),
        "malformed": got["error"].isNotNull(),
        "ragged": F.exists(body, lambda r: F.size(r) != F.size(header)),
        "duplicate-header": F.size(F.array_distinct(header)) < F.size(header),
        "empty-header": F.exists(header, lambda h: F.btrim(h) == ""),
        "placeholder": F.exists(body, lambda r: F.exists(r, lambda x: F.lower(F.btrim(x)).isin(*PLACEHOLDERS))),
    }
    if banned:
        checks["banned-column"] = F.arrays_overlap(lower, F.array(*map(F.lit, banned)))
    return F.array_sort(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])))


def cross_check(exported: DataFrame, stored: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row: ids only in either, and for each column the rows that differ (null equals null). Both sides have unique keys."""
    left = exported.select(F.col(key), F.struct(*columns).alias("a"))
    right = stored.select(F.col(key), F.struct(*columns).alias("b"))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    differ = [F.count_if(both & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))).alias(f"{c}_differ") for c in columns]
    return left.join(right, key, "full").agg(F.count_if(F.col("b").isNull()).alias("only_exported"), F.count_if(F.col("a").isNull()).alias("only_stored"), *differ)
