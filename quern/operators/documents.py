"""Schemaless documents as VARIANT columns: filter documents compiled to columns, latest-first reads, and probing of linked data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of types in a filter, and the types of VARIANT values that they stand for.
KINDS = {"string": "STRING", "bool": "BOOLEAN", "number": "(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*)", "array": "ARRAY.*", "object": "OBJECT.*", "null": "VOID"}


def at(doc: Column, path: str, kind: str = "variant") -> Column:
    """The value at a path of names ('a.b'); null where there is none or it is of another kind."""
    return F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in path.split(".")), kind)


def is_kind(doc: Column, path: str, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(at(doc, path)).rlike(f"^{KINDS[name]}$"), F.lit(False))


def equals(doc: Column, path: str, value: object) -> Column:
    """Whether the value at a path is `value`, of the same type, or a list that has it. None stands for null and for no value."""
    if value is None:
        return at(doc, path).isNull() | is_kind(doc, path, "null")
    if isinstance(value, bool):
        same = is_kind(doc, path, "bool") & (at(doc, path, "boolean") == value)
        items = "array<boolean>"
    elif isinstance(value, int | float):
        same = is_kind(doc, path, "number") & (at(doc, path, "double") == float(value))
        items, value = "array<double>", float(value)
    else:
        same = is_kind(doc, path, "string") & (at(doc, path, "string") == value)
        items = "array<string>"
    held = F.coalesce(F.schema_of_variant(at(doc, path)).rlike(f"^ARRAY<{KINDS[{'array<boolean>': 'bool', 'array<double>': 'number'}.get(items, 'string')]}>$"), F.lit(False)) & F.array_contains(at(doc, path, items), value)
    return F.coalesce(same, F.lit(False)) | F.coalesce(held, F.lit(False))


def _compared(doc: Column, path: str, sign: str, value: object) -> Column:
    kind, cast = ("string", "string") if isinstance(value, str) else ("number", "double")
    got = at(doc, path, cast)
    test = {"$gt": got > value, "$gte": got >= value, "$lt": got < value, "$lte": got <= value}[sign]
    return is_kind(doc, path, kind) & F.coalesce(test, F.lit(False))


def _tested(doc: Column, path: str, sign: str, value: object) -> Column:
    if sign == "$in":
        return reduce(Column.__or__, [equals(doc, path, v) for v in value], F.lit(False))
    if sign == "$nin":
        return ~_tested(doc, path, "$in", value)
    if sign == "$eq":
        return equals(doc, path, value)
    if sign == "$ne":
        return ~equals(doc, path, value)
    if sign == "$exists":
        return at(doc, path).isNotNull() if value else at(doc, path).isNull()
    if sign == "$type":
        return is_kind(doc, path, value)
    if sign == "$regex":
        return is_kind(doc, path, "string") & F.coalesce(at(doc, path, "string").rlike(value), F.lit(False))
    if sign in ("$gt", "$gte", "$lt", "$lte"):
        return _compared(doc, path, sign, value)
    raise ValueError(f"unknown operator {sign}")


def matches(doc: Column, spec: dict) -> Column:
    """A filter document as a column that is true or false for every document that is not null. All its entries must hold: a path with a value
    or with operators, or $or and $and with lists of filters."""
    tests = []
    for key, want in spec.items():
        if key in ("$or", "$and"):
            tests.append(reduce(Column.__or__ if key == "$or" else Column.__and__, [matches(doc, s) for s in want]))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(want, dict) and want and all(k.startswith("$") for k in want):
            tests += [_tested(doc, key, sign, value) for sign, value in want.items()]
        else:
            tests.append(equals(doc, key, want))
    return reduce(Column.__and__, tests, F.lit(True))


def _once(docs: DataFrame, column: str, *keep: str) -> DataFrame:
    """The column behind a generator, which keeps the optimizer from parsing a document again for every path that is asked of it."""
    return docs.select(*keep, F.explode(F.array(column)).alias(column))


def find(docs: DataFrame, column: str, spec: dict, fields: dict[str, str], latest: str | None = None, limit: int | None = None) -> DataFrame:
    """The documents of VARIANT column `column` that match, as `fields` (path and type); latest first by a number at `latest`, ties by the
    fields in order, `limit` at most. What a projection does not name does not leave."""
    doc = F.col(column)
    shown = _once(docs, column).where(doc.isNotNull() & matches(doc, spec)).select(*[at(doc, p, kind).alias(p.replace(".", "_")) for p, kind in fields.items()], *([at(doc, latest, "double").alias("_latest")] if latest else []))
    if latest:
        shown = shown.orderBy(F.desc_nulls_last("_latest"), *[p.replace(".", "_") for p in fields])
    if limit is not None:
        shown = shown.limit(limit)
    return shown.drop("_latest")


def described(docs: DataFrame) -> DataFrame:
    """key, found and variant: the description that a crawled page states in its metadata, or in linked data: on top, under its source
    organisation, or in the first node that has one, of its graph or of graphs inside nodes. Values of a wrong type are passed over.

    docs: key, doc (VARIANT with metadata and jsonLd).
    """
    docs = _once(docs, "doc", "key")
    text = lambda p: F.when(is_kind(F.col("doc"), p, "string"), F.nullif(at(F.col("doc"), p, "string"), F.lit("")))
    nodes = docs.sparkSession.sql("SELECT d.key, g.pos AS p, -1 AS q, g.value AS doc FROM {docs} d, LATERAL variant_explode(try_variant_get(d.doc, '$.jsonLd[\"@graph\"]', 'variant')) g WHERE schema_of_variant(try_variant_get(d.doc, '$.jsonLd[\"@graph\"]', 'variant')) LIKE 'ARRAY%'", docs=docs)
    inner = docs.sparkSession.sql("SELECT n.key, n.p, g.pos AS q, g.value AS doc FROM {nodes} n, LATERAL variant_explode(try_variant_get(n.doc, '$[\"@graph\"]', 'variant')) g WHERE schema_of_variant(try_variant_get(n.doc, '$[\"@graph\"]', 'variant')) LIKE 'ARRAY%'", nodes=nodes)
    stated = nodes.unionByName(inner).select("key", "p", "q", text("description").alias("d")).where("d IS NOT NULL")
    first = stated.groupBy("key").agg(F.min_by("d", F.struct("p", "q")).alias("graph"))
    meta, top, source = text("metadata.description"), text("jsonLd.description"), text("jsonLd.sourceOrganization.description")
    each = docs.select("key", meta.alias("meta"), F.coalesce(top, source).alias("ld")).join(first, "key", "left")
    variant = F.when(F.col("meta").isNotNull(), "meta-description").when(F.coalesce("ld", "graph").isNotNull(), "json-ld")
    return each.select("key", F.coalesce("meta", "ld", "graph").alias("found"), variant.alias("variant"))
