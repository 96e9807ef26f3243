"""Names of entities in texts: a lexicon of distinctive forms, and a longest-match scan without overlaps.

The scan finds a text's n-grams among the forms; only the choice among one text's own hits is a fold, over an array that the text
itself bounds. The lexicon is written once. A small one goes to the texts, which are cut once and follow its forms word by word, so that n-grams,
many times the texts, are never made; a large one meets them in an equality join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.operators import terms
from quern.storage import dealt, materialise

LONGEST = 6
#: A lexicon of at most so many forms goes to the texts; with more, it meets their n-grams in a shuffled join.
SMALL_LEXICON = 100_000
RARE_DF = 6
COMMON_PENALTY = 0.25
KIND_WEIGHT = {"primary": 1.0, "associated": 0.6, "code": 1.0}
# Names that are ordinary words too.
COMMON_NAMES = (
    "able ace act aim alliance anchor apex arc arrow aspire atlas aurora axis beam bloom blue bolt bond boost branch bridge bright bureau cache "
    "canopy capital cargo chain chime circle clarity cloud coast compass core craft credit crest cube current dash dawn delta draft drive eagle "
    "echo edge element ember engine equity everest fabric finance flow focus forge form forward fusion gateway grid grow growth harbour harvest "
    "haven horizon hub impact insight ivy jump keystone ledger legacy lens lift link loop lumen meridian mesh mint momentum motion nest nova "
    "nugget oak onward orbit origin path peak pillar pilot pivot plane pulse quest raise ramp range reach ridge rise river root scale shield "
    "shift signal slice spark sphere spring sprout stack stride summit surge swift thread tide trust unity vault venture vertex vista wave wise zenith"
).split()


def lexicon(forms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Distinct (form, id, kind) of the distinctive forms: several tokens, or one of three letters in at most RARE_DF documents.

    `forms` has form, id, kind; `frequencies` has term and df. Null and blank forms are left out.
    """
    bare = forms.select(F.btrim("form").alias("form"), "id", "kind").where("form <> ''").distinct()
    df = frequencies.select(F.col("term").alias("form"), "df")
    single = ~F.contains("form", F.lit(" "))
    return bare.join(df, "form", "left").where(~single | ((F.length("form") >= 3) & (F.coalesce("df", F.lit(0)) <= RARE_DF))).drop("df")


def capitalised(c: str | Column) -> Column:
    """Normalised words after the first that start with a capital; none in a text of capitals alone."""
    words = F.filter(F.split(F.coalesce(tx.col(c), F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    glued = F.array_join(words, "")
    named = F.array_distinct(F.filter(F.transform(F.filter(words, lambda w, i: (i > 0) & w.rlike("^[A-Z]")), tx.normalise_name), lambda w: w != ""))
    return F.when(glued == F.upper(glued), F.slice(named, 1, 0)).otherwise(named)


def grams(tokens: Column, longest: int = LONGEST) -> Column:
    """Structs of position, length, gram and `alt` (1 for the stem of a single token) of all n-grams up to `longest`."""
    size = F.size(tokens)

    def at(i: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i)), lambda n: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("gram"), F.lit(0).alias("alt")))
        stem = F.struct(i.alias("pos"), F.lit(1).alias("n"), tx.stem_plural(F.get(tokens, i)).alias("gram"), F.lit(1).alias("alt"))
        return F.array_append(each, stem)

    starts = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, at))


class Forms:
    """Forms as a tree of words: from a node, a word leads to the node of a longer form. Node 0 is the empty form."""

    def __init__(self, forms: list[str]) -> None:
        self.forms = pa.array(forms, pa.string())
        number: dict[str, int] = {}
        ways: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i, form in enumerate(forms):
            words, node = form.split(" "), 0
            if len(words) <= LONGEST:
                for word in words:
                    node = ways.setdefault((node, number.setdefault(word, len(number))), len(ways) + 1)
                ends[node] = i
        self.words, self.size = pa.array(list(number), pa.string()), len(number)
        self.form = np.full(len(ways) + 1, -1)
        self.form[list(ends)] = list(ends.values())
        key = np.array([node * self.size + word for node, word in ways], np.int64)
        order = np.argsort(key)
        self.key, self.to = np.r_[key[order], np.iinfo(np.int64).max], np.r_[np.fromiter(ways.values(), np.int64, len(ways))[order], 0]

    def follow(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Where words lead from nodes; 0 is nowhere."""
        key = node * self.size + word
        at = np.searchsorted(self.key, key)
        return np.where((word >= 0) & (self.key[at] == key), self.to[at], 0)

    def _numbers(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, self.words), -1).to_numpy()

    def hits(self, found: pa.Array, doc: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Place, length, `alt` and form of each hit in terms of texts as `terms.read` gives them, a stem for a term counting as in `grams`."""
        words = self._numbers(found)
        plural = np.flatnonzero(pc.ends_with(found, "s").to_numpy(zero_copy_only=False))
        alone = np.full(len(found), -1)  # the form that the stem of a term is
        stems = self._numbers(pa.array([tx.stem_of(t) for t in found.take(pa.array(plural)).to_pylist()], pa.string()))
        alone[plural] = self.form[self.follow(np.zeros(len(stems), np.int64), stems)]
        root = self.follow(np.zeros(len(found), np.int64), words)
        out = []
        at = np.flatnonzero(alone[number] >= 0)
        out.append((at, np.ones(len(at), np.int64), np.ones(len(at), np.int64), alone[number[at]]))
        at = np.flatnonzero(root[number])
        node = root[number[at]]
        for n in range(1, LONGEST + 1):
            ends = self.form[node] >= 0
            out.append((at[ends], np.full(ends.sum(), n), np.zeros(ends.sum(), np.int64), self.form[node[ends]]))
            more = np.flatnonzero(at + n < len(doc))
            more = more[doc[at[more] + n] == doc[at[more]]]
            at, node = at[more], self.follow(node[more], words[number[at[more] + n]])
            at, node = at[node > 0], node[node > 0]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _met(batches: Iterator[pa.RecordBatch], forms: Forms) -> Iterator[pa.RecordBatch]:
    """qid, hits and, where a hit is an ordinary word, the text, of texts (qid, text) that have a hit."""
    for part in terms.slices(batches, "text"):
        found, doc, number = terms.read(part.column("text"), True)
        at, n, alt, form = forms.hits(found, doc, number)
        order = np.argsort(at, kind="stable")
        at, n, alt, form = at[order], n[order], alt[order], form[order]
        of = doc[at]
        held, starts = np.unique(of, return_index=True)
        pos = at - np.searchsorted(doc, of)
        gram = forms.forms.take(pa.array(form))
        hits = pa.StructArray.from_arrays([pa.array(pos.astype(np.int32)), pa.array((-n).astype(np.int32)), pa.array(alt.astype(np.int32)), gram], ["pos", "less", "alt", "gram"])
        plain = np.zeros(len(part), bool)
        plain[of[(n == 1) & pc.is_in(gram, pa.array(COMMON_NAMES)).to_numpy(zero_copy_only=False)]] = True
        rows = part.take(pa.array(held))
        text = pc.if_else(pa.array(plain[held]), rows.column("text"), pa.scalar(None, pa.string()))
        yield pa.RecordBatch.from_arrays([rows.column("qid"), pa.ListArray.from_arrays(pa.array(np.r_[starts, len(at)].astype(np.int32)), hits), text], ["qid", "hits", "text"])


def scan(texts: DataFrame, lex: DataFrame) -> DataFrame:
    """qid, form, id, kind and boost of every name in the texts (qid, text), each as often as it occurs.

    At each place the longest form wins and the scan goes on behind it. Longer names weigh more, names of many entries less,
    and a single ordinary word in lower case a quarter. Texts without names or a qid, null and empty ones give no rows.
    """
    lex = materialise(lex, "lexicon")
    forms = lex.select("form").distinct()
    small = forms.count() <= SMALL_LEXICON
    entries = lex.join(lex.groupBy("form").agg(F.count("*").alias("entries")), "form")
    if small:
        shared = texts.sparkSession.sparkContext.broadcast(Forms([r.form for r in forms.collect()]))
        kind = f"qid {texts.schema['qid'].dataType.simpleString()}, hits array<struct<pos:int,less:int,alt:int,gram:string>>, text string"
        met = texts.where("qid IS NOT NULL").select("qid", F.col("text").cast("string").alias("text")).mapInArrow(terms.freeing(lambda b: _met(b, shared.value)), kind)
        met = met.withColumn("caps", capitalised("text"))
        if lex.count() <= SMALL_LEXICON:
            entries = F.broadcast(entries)
    else:
        split = texts.select("qid", tx.tokens("text", keep_stopwords=True).alias("tokens"))
        each = split.select("qid", F.inline(grams(F.col("tokens")))).join(forms.withColumnRenamed("form", "gram"), "gram")
        met = each.groupBy("qid").agg(F.collect_list(F.struct("pos", (-F.col("n")).alias("less"), "alt", "gram")).alias("hits"))
        met = met.join(texts.select("qid", capitalised("text").alias("caps")), "qid")
    kind = "struct<free:int,kept:array<struct<form:string,n:int>>>"
    chosen = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).alias("free"), F.array().alias("kept")).cast(kind),
        lambda acc, x: F.when(
            x["pos"] >= acc["free"],
            F.struct((x["pos"] - x["less"]).alias("free"), F.array_append(acc["kept"], F.struct(x["gram"].alias("form"), (-x["less"]).alias("n"))).alias("kept")).cast(kind),
        ).otherwise(acc),
        lambda acc: acc["kept"],
    )
    found = met.select("qid", "caps", F.inline(chosen))
    weight = F.lit(0.0)
    for name, w in KIND_WEIGHT.items():
        weight = F.when(F.col("kind") == name, w).otherwise(weight)
    plain = (F.col("n") == 1) & F.col("form").isin(*COMMON_NAMES) & ~F.array_contains("caps", F.col("form"))
    boost = weight * (1 + 0.35 * (F.col("n") - 1)) / F.sqrt("entries") * F.when(plain, COMMON_PENALTY).otherwise(1.0)
    return found.join(entries, "form").select("qid", "form", "id", "kind", boost.alias("boost"))


def total(found: DataFrame, rows: int | None = None) -> DataFrame:
    """qid, id and boost: the hits of an entity with diminishing returns, the i-th strongest over i. rows: how many hits there are at most.

    Hits of equal boosts add the same in any order, so their forms are neither shuffled nor sorted.
    """
    hits = dealt(found.select("qid", "id", "boost"), rows, "qid", "id")
    nth = F.row_number().over(Window.partitionBy("qid", "id").orderBy(F.desc("boost")))
    return hits.withColumn("nth", nth).groupBy("qid", "id").agg(F.sum(F.col("boost") / F.col("nth")).alias("boost"))
