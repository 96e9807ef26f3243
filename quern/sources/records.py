"""Feeds of records: folders of JSON arrays, JSON lines with inferred types, and payloads embedded in pages."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType, StructType

KINDS = ("partner", "speaker", "session")
# Fixed value: how a page pushes a piece of its payload.
PAYLOAD = r'(?s)self\.__next_f\.push\(\[1,\s*(".*?")\]\)'


def record_type(line: str | Column) -> Column:
    """The type of a JSON object: as it says, or by the keys it has; null where neither tells."""
    c = F.col(line) if isinstance(line, str) else line
    said = F.coalesce(F.get_json_object(c, "$.type"), F.get_json_object(c, "$.recordType"))
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    has = lambda *ks: F.arrays_overlap(keys, F.array(*map(F.lit, ks)))
    inferred = F.when(has("agendaCode", "isClosedDoor"), "session").when(has("tier", "slug"), "partner").when(has("nameKey", "bio"), "speaker")
    return F.when(said.isin(*KINDS), said).otherwise(inferred)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """`body` (variant), `kind` and `skip` of non-blank lines; skip names why a line is no record, and is null for records.

    A line that is no JSON, no object or of no known type is kept with its reason, so that skips can be counted.
    """
    body = F.try_parse_json(F.col(column))
    kept = lines.where(F.col(column).rlike(r"[^ \t-\r]")).select(F.col(column).alias("line"), body.alias("body"))
    is_object = F.col("line").rlike(r"^[ \t-\r]*\{")
    kind = F.when(F.col("body").isNotNull() & is_object, record_type("line"))
    skip = F.when(F.col("body").isNull(), "bad-json").when(~is_object, "not-an-object").when(kind.isNull(), "unknown-type")
    return kept.select("line", "body", kind.alias("kind"), skip.alias("skip"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path))


def read_folder(spark: SparkSession, folder: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """Arrays of records in <folder>/<name>.json by name; a missing file is an empty table, and only missing files are an error."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    found = {}
    for name, schema in schemas.items():
        path = fs_path(f"{folder.rstrip('/')}/{name}.json")
        there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
        found[name] = spark.read.schema(schema).option("multiLine", True).json(path.toString()) if there else None
    if not any(x is not None for x in found.values()):
        raise FileNotFoundError(f"{folder} has none of {', '.join(schemas)}")
    return {n: spark.createDataFrame([], schemas[n]) if x is None else x for n, x in found.items()}


def choose(lines: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """The records of the lines if there are any, else the fallback."""
    records = None if lines is None else lines.where("skip is null")
    return fallback if records is None or records.isEmpty() else records


def payload(html: str | Column) -> Column:
    """The string literals that a page pushes, unescaped and joined in order; null if it has none. Broken literals are left out."""
    literals = F.regexp_extract_all(F.col(html) if isinstance(html, str) else html, F.lit(PAYLOAD), F.lit(1))
    texts = F.array_compact(F.transform(literals, lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), "array<string>"), F.lit(0))))
    return F.when(F.size(texts) > 0, F.array_join(texts, ""))


def grab(blob: str | Column, key: str) -> Column:
    """The JSON value after the first `"key":` in a text, as JSON text; null if the key is absent or no value follows.

    What follows the value may be anything, which Spark's JSON functions refuse, so a decoder that stops behind it reads the rest.
    """
    text = F.col(blob) if isinstance(blob, str) else blob
    mark = F.instr(text, F.lit(f'"{key}":'))
    rest = F.when(mark > 0, F.ltrim(F.substring(text, mark + len(key) + 3, F.length(text)), F.lit(" \n")))
    return _leading_value(rest)


@pandas_udf(StringType())
def _leading_value(texts: pd.Series) -> pd.Series:
    decoder = json.JSONDecoder()

    def first(text: str | None) -> str | None:
        try:
            found = decoder.raw_decode(text) if text else None
        except ValueError:
            found = None
        return None if found is None else json.dumps(found[0], ensure_ascii=False, separators=(",", ":"))

    return texts.map(first)

