"""Audit of how far the sources of each language diverge in their terms, by mergeable radix tries.

Every task counts the terms of its texts and holds them in byte tries, one a language: inner nodes branch by the next byte, and a node of
few enough leaves is a container of sorted rests behind a common prefix, with a counter a source and the number of documents at each leaf.
A traversal gives the terms in UTF-8 order. Tries are merged by prefix ranges: containers are cut where ranges meet, and those of one
range are added up, leaf by leaf. What enough documents hold is kept in blocks of terms with their counters. Blocks meet the totals of their
language and stream two things: sums of differences for pairs of sources, and each source's leading terms, whose ties stand in the order
of UTF-8.

Defined results: null text, lang or source counts as ''. Repeated rows count again. A (lang, source) without kept terms still has its
pairs; a language without kept terms has pairs of value 0. Extra columns are ignored; an empty table gives an empty result. All sums
are of whole numbers, so reruns on any partitioning agree.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import map_batches, materialise

LEAST_DOCS = 30
TOP = 50
SMOOTHING = 5
SCALE = 1_000_000_000


@dataclass(frozen=True)
class Bounds:
    """What a task holds at a time; results do not depend on it."""

    counts: int = 400_000  # counters that a task holds before it gives its tries
    leaves: int = 4_096  # leaves of a container
    range: int = 150_000  # leaves of a prefix range, about
    block: int = 1 << 15  # leaf counters of a block of kept terms, about
    cells: int = 1 << 21  # cells of a matrix of terms by sources
    tile: int = 128  # sources of a block that are compared with all others
    rows: int = 8_192  # rows of a batch


def _byte_table() -> bytes:
    """Letters of ASCII in lower case and bytes above 127 as they are, a space for all others."""
    kept = {b: b for b in (*range(0x61, 0x7B), *range(0x80, 0x100))} | {b: b + 32 for b in range(0x41, 0x5B)}
    return bytes(kept.get(b, 0x20) for b in range(256))


BYTES = _byte_table()


class Trie:
    """A radix trie of one language. `terms` are its leaves in order, with the documents of each; counters stand leaf after leaf, those of a
    leaf up to its `ends`, with the number of a source and a count."""

    def __init__(self, docs: Counter, by_source: dict[str, Counter]) -> None:
        self.terms = sorted(docs)
        self.df = np.fromiter(map(docs.__getitem__, self.terms), np.int64, len(self.terms))
        self.sources = sorted(by_source)
        place = dict(zip(self.terms, range(len(self.terms)), strict=True))
        leaf = np.concatenate([np.fromiter(map(place.__getitem__, c), np.int64, len(c)) for c in (by_source[s] for s in self.sources)])
        counts = np.concatenate([np.fromiter(by_source[s].values(), np.int64, len(by_source[s])) for s in self.sources])
        which = np.repeat(np.arange(len(self.sources)), [len(by_source[s]) for s in self.sources])
        order = np.argsort(leaf, kind="stable")
        self.which, self.counts = which[order], counts[order]
        self.ends = np.cumsum(np.bincount(leaf, minlength=len(self.terms)))

    def containers(self, most: int) -> Iterator[tuple[bytes, int, int]]:
        """The trie's lowest nodes in order: their prefix, and where their leaves begin and end. Inner nodes have more than `most` leaves."""
        stack = [(0, len(self.terms))]
        while stack:
            lo, hi = stack.pop()
            if lo == hi:
                continue
            first, last = self.terms[lo], self.terms[hi - 1]  # in sorted leaves these two share what all share
            depth = next((i for i, (a, b) in enumerate(zip(first, last, strict=False)) if a != b), min(len(first), len(last)))
            if hi - lo <= most:
                yield first[:depth], lo, hi
                continue
            cuts, at = [lo], lo + (len(first) == depth)  # a leaf at the node itself stands first
            if at > lo:
                cuts.append(at)
            while at < hi:
                after = self.terms[at][: depth + 1]
                at = hi if after[-1] == 0xFF else bisect_left(self.terms, after[:-1] + bytes([after[-1] + 1]), at, hi)
                cuts.append(at)
            stack.extend(reversed(list(zip(cuts, cuts[1:], strict=False))))


NODES = "lang string, prefix binary, rests array<binary>, df array<long>, sources array<string>, ends array<int>, which array<int>, counts array<long>"
_NODES = pa.schema([
    ("lang", pa.string()), ("prefix", pa.binary()), ("rests", pa.list_(pa.binary())), ("df", pa.list_(pa.int64())), ("sources", pa.list_(pa.string())), ("ends", pa.list_(pa.int32())),
    ("which", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


def _row(schema: pa.Schema, values: list) -> pa.RecordBatch:
    """A batch of one row, its lists from arrays as they are."""
    columns = []
    for f, x in zip(schema, values, strict=True):
        if pa.types.is_list(f.type):
            x = pa.array(x, f.type.value_type)
            columns.append(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
        else:
            columns.append(pa.array([x], f.type))
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _nodes(counts: dict[str, dict[str, Counter]], docs: dict[str, Counter], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    for lang in sorted(docs):
        trie = Trie(docs[lang], counts[lang])
        for prefix, lo, hi in trie.containers(bounds.leaves):
            at = slice(trie.ends[lo - 1] if lo else 0, trie.ends[hi - 1])
            met, which = np.unique(trie.which[at], return_inverse=True)
            rests = [t[len(prefix) :] for t in trie.terms[lo:hi]]
            yield _row(_NODES, [lang, prefix, rests, trie.df[lo:hi], [trie.sources[i] for i in met], trie.ends[lo:hi] - at.start, which, trie.counts[at]])


def _count(batches: Iterator[pa.RecordBatch], bounds: Bounds) -> Iterator[pa.RecordBatch]:
    counts: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    docs: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts, strict=True):
            terms = text.translate(BYTES).split()
            if terms:
                counts[lang][source].update(terms)
                docs[lang].update(set(terms))
        if sum(len(c) for by_source in counts.values() for c in by_source.values()) > bounds.counts:
            yield from _nodes(counts, docs, bounds)
            counts.clear()
            docs.clear()
    yield from _nodes(counts, docs, bounds)


def tries(docs: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """The containers of the tries of all tasks. A term is a leaf in each trie that holds it."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return map_batches(docs.select(*blank), partial(_count, bounds=bounds), NODES)


#: Bytes of a term by which ranges are told apart; terms that agree in them and are very many are dealt by a hash.
KEY_BYTES = 7


def _keys(terms: list[bytes]) -> np.ndarray:
    return np.fromiter((int.from_bytes(t[:KEY_BYTES].ljust(KEY_BYTES, b"\0"), "big") for t in terms), np.int64, len(terms))


def _ranges(terms: list[bytes], cuts: np.ndarray) -> np.ndarray:
    """The range of each term. A key that takes up several ranges is dealt out among them."""
    keys = _keys(terms)
    first, last = np.searchsorted(cuts, keys, side="left"), np.searchsorted(cuts, keys, side="right")
    wide = np.flatnonzero(last - first > 1)
    found = last.copy()
    for i in wide:
        found[i] = first[i] + 1 + zlib.crc32(terms[i]) % (last[i] - first[i])
    return found


def _cut(batches: Iterator[pa.RecordBatch], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Containers cut where prefix ranges meet, with the number of the range."""
    schema = pa.schema([*_NODES, ("range", pa.int32())])
    for batch in batches:
        for i in range(len(batch)):
            lang, prefix = batch.column("lang")[i].as_py(), batch.column("prefix")[i].as_py()
            rests, sources = batch.column("rests")[i].as_py(), batch.column("sources")[i].as_py()
            df, ends, which, counts = (batch.column(c)[i].values.to_numpy() for c in ("df", "ends", "which", "counts"))
            of = _ranges([prefix + r for r in rests], cuts)
            if of.min() == of.max():
                yield _row(schema, [lang, prefix, rests, df, sources, ends, which, counts, int(of[0])])
                continue
            sizes = np.diff(ends, prepend=0)
            of_counter = np.repeat(of, sizes)
            for n in np.unique(of):
                leaves, mine = np.flatnonzero(of == n), of_counter == n
                yield _row(schema, [lang, prefix, [rests[k] for k in leaves], df[leaves], sources, np.cumsum(sizes[leaves]), which[mine], counts[mine], int(n)])


BLOCKS = "lang string, sources array<string>, totals array<long>, terms array<binary>, ends array<int>, which array<int>, counts array<long>"
_BLOCKS = pa.schema([
    ("lang", pa.string()), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary())), ("ends", pa.list_(pa.int32())),
    ("which", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
])


def _merge(batches: Iterator[pa.RecordBatch], least: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Add up the containers of each range, which come together, and give the terms of `least` documents in blocks."""
    held: list[dict] = []
    for batch in batches:
        for row in range(len(batch)):
            x = {c: batch.column(c)[row] for c in batch.schema.names}
            key = x["lang"].as_py(), x["range"].as_py()
            if held and held[0]["key"] != key:
                yield from _added(held, least, bounds)
                held = []
            held.append({c: v.as_py() for c, v in x.items() if c in ("prefix", "rests", "sources")} | {c: x[c].values.to_numpy() for c in ("df", "ends", "which", "counts")} | {"key": key})
    if held:
        yield from _added(held, least, bounds)


def _added(nodes: list[dict], least: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    terms = pa.array([n["prefix"] + r for n in nodes for r in n["rests"]], pa.binary())
    sums = pa.table({"term": terms, "df": np.concatenate([n["df"] for n in nodes])}).group_by("term").aggregate([("df", "sum")])
    kept = sums.filter(pc.greater_equal(sums.column("df_sum"), least)).column("term").combine_chunks()
    kept = kept.take(pc.sort_indices(kept))
    if not len(kept):
        return
    of_leaf = pc.fill_null(pc.index_in(terms, value_set=kept), -1).to_numpy().astype(np.int64)
    leaf = np.repeat(of_leaf, np.concatenate([np.diff(n["ends"], prepend=0) for n in nodes]))
    number: dict[str, int] = {}
    which = np.concatenate([np.array([number.setdefault(s, len(number)) for s in n["sources"]], np.int64)[n["which"]] for n in nodes])
    counts, good = np.concatenate([n["counts"] for n in nodes]), leaf >= 0
    cell, back = np.unique(leaf[good] * len(number) + which[good], return_inverse=True)
    total = np.zeros(len(cell), np.int64)
    np.add.at(total, back, counts[good])
    leaf, which = np.divmod(cell, len(number))
    ends, names = np.searchsorted(leaf, np.arange(len(kept)), side="right"), list(number)
    at = 0
    while at < len(kept):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + bounds.block, side="right")))
        part = slice(done, ends[to - 1])
        met, own = np.unique(which[part], return_inverse=True)
        sums_of = np.zeros(len(met), np.int64)
        np.add.at(sums_of, own, total[part])
        yield _row(_BLOCKS, [nodes[0]["key"][0], [names[i] for i in met], sums_of, kept.slice(at, to - at), ends[at:to] - done, own, total[part]])
        at = to


def kept_terms(counted: DataFrame, least: int = LEAST_DOCS, bounds: Bounds = Bounds()) -> DataFrame:
    """Blocks of the terms that at least `least` documents of their language hold, from written containers, merged by prefix ranges.

    Ranges are set by quantiles of the containers' prefixes; where they lie does not change the result.
    """
    key = F.conv(F.hex(F.rpad(F.substring(F.concat("prefix", F.get("rests", F.lit(0))), 1, KEY_BYTES), KEY_BYTES, F.lit(b"\0"))), 16, 10).cast("long")
    total = counted.agg(F.sum(F.size("rests").cast("long")).alias("n")).first().n or 0
    n = -(-total // bounds.range)
    cuts = np.empty(0, np.int64)
    if n > 1:
        steps = [i / n for i in range(1, n)]
        found = counted.select(key.alias("key"), F.size("rests").alias("w")).agg(F.percentile_approx("key", steps, 10_000).alias("cuts")).first().cuts
        cuts = np.array(found, np.int64)
    ranged = counted.mapInArrow(partial(_cut, cuts=cuts), NODES + ", range int")
    return ranged.repartition("lang", "range").sortWithinPartitions("lang", "range").mapInArrow(partial(_merge, least=least, bounds=bounds), BLOCKS)


def profiles(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row a language: lang, v (kept terms), sources in order and their totals over kept terms, every source that occurs."""
    blank = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    sums = blocks.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("totals").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select(*blank).distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["n"])
    sizes = blocks.groupBy("lang").agg(F.sum(F.size("terms").cast("long")).alias("v"))
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("all"))
    return listed.join(sizes, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).cast("long").alias("v"), F.col("all.source").alias("sources"), F.col("all.n").alias("ns"))


def shares(counts: np.ndarray, totals: np.ndarray, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 5) / (total + 5 * v)), exact for any counts."""
    above, below = counts + SMOOTHING, totals + SMOOTHING * v
    if max(above.max(initial=0), below.max(initial=0)) < (1 << 63) // SCALE:
        return 1 + above * SCALE // below
    return np.array(1 + above.astype(object) * SCALE // below.astype(object), np.int64)


_FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _compare(batches: Iterator[pa.RecordBatch], top: int, bounds: Bounds) -> Iterator[pa.RecordBatch]:
    """Of each block and tile of sources: sums of differences to all sources, and the leading terms of the tile's sources."""
    for batch in batches:
        for row in batch.to_pylist():
            names, ns, v = row["all_sources"], np.array(row["ns"], np.int64), row["v"]
            place = {s: i for i, s in enumerate(names)}
            which = np.array([place[s] for s in row["sources"]], np.int64)[np.array(row["which"], np.int64)]
            counts, ends = np.array(row["counts"], np.int64), np.array(row["ends"], np.int64)
            of_term = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            lo, hi = row["tile"] * bounds.tile, min(len(names), (row["tile"] + 1) * bounds.tile)
            sums = np.zeros((hi - lo, len(names)), np.int64)
            lead: list[list[tuple[int, bytes]]] = [[] for _ in range(lo, hi)]
            step = max(1, bounds.cells // len(names))
            for a in range(0, len(ends), step):
                b = min(len(ends), a + step)
                at = slice(ends[a - 1] if a else 0, ends[b - 1])
                c = np.zeros((b - a, len(names)), np.int64)
                c[of_term[at] - a, which[at]] = counts[at]
                p, q = shares(c, ns[None, :], v), shares(c.sum(1), ns.sum(keepdims=True), v)
                for i in range(lo, hi):
                    sums[i - lo] += np.abs(p - p[:, i : i + 1]).sum(0)
                    over = np.where(c[:, i] > 0, p[:, i] - q, 0)
                    some = np.flatnonzero(over > 0)
                    best = some[np.argsort(-over[some], kind="stable")[:top]]  # stable: ties stay in the order of bytes
                    lead[i - lo] = sorted(lead[i - lo] + [(-int(over[k]), row["terms"][a + k]) for k in best])[:top]
            found = [(row["lang"], names[i], "pair", names[j], int(sums[i - lo, j])) for i in range(lo, hi) for j in range(len(names)) if i != j]
            found += [(row["lang"], names[i], "term", term.decode("utf-8", "replace"), -less) for i in range(lo, hi) for less, term in lead[i - lo]]
            for k in range(0, len(found), bounds.rows):
                yield _rows(found[k : k + bounds.rows], _FOUND)


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, bounds: Bounds = Bounds()) -> DataFrame:
    """lang, source, part, item, value and rank, as the module says. docs: lang, source, text.

    Work and result grow with the square of the number of sources of a language, since every pair of them is asked for.
    """
    counted = materialise(tries(docs, bounds), "tries")
    blocks = materialise(kept_terms(counted, least, bounds), "kept-terms")
    each = materialise(profiles(docs, blocks), "profiles")
    met = blocks.join(each.withColumnRenamed("sources", "all_sources"), "lang")
    tiled = met.withColumn("tile", F.explode(F.sequence(F.lit(0), F.floor((F.size("all_sources") - 1) / bounds.tile).cast("int"))))
    found = map_batches(tiled, partial(_compare, top=top, bounds=bounds), "lang string, source string, part string, item string, value long", rows=4)
    nothing = each.where("v = 0").select("lang", F.explode("sources").alias("source"), "sources").select("lang", "source", F.lit("pair").alias("part"), F.explode("sources").alias("item"), F.lit(0).cast("long").alias("value"))
    found = found.unionByName(nothing.where("source <> item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    nth = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked_terms = found.where("part = 'term'").withColumn("rank", nth).where(F.col("rank") <= top)
    return pairs.withColumn("rank", nth).unionByName(ranked_terms).select("lang", "source", "part", "item", "value", "rank")


def op13(docs: DataFrame) -> DataFrame:
    return audit(docs)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SHARE = f"1 + ({SCALE}::HUGEINT * ({{c}} + {SMOOTHING})) // ({{n}} + {SMOOTHING}::HUGEINT * v)"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOWER} AS body FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, unnest(regexp_extract_all(body, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= {LEAST_DOCS}),
vs AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT d.lang, d.source, coalesce(v, 0) AS v, coalesce(n, 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN vs USING (lang) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY ALL) s USING (lang, source)),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, {_SHARE.format(c='coalesce(c.c, 0)', n='n')} AS p FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT lang, term, {_SHARE.format(c='sum(c)', n='any_value(tn)')} AS q FROM p JOIN (SELECT lang, any_value(v) AS v, sum(n) AS tn FROM g GROUP BY lang) USING (lang) GROUP BY lang, term, v),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.f, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y USING (lang, term) GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT * FROM r WHERE part = 'pair' OR rank <= {TOP}"""
