import struct
from collections import Counter, defaultdict
from fractions import Fraction

import xxhash
from pyspark.sql import functions as F

from quern.llm import mixing
from tests.llm import cases


def fill(sizes):
    """Targets by resharing the excess until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(order)
    while True:
        left, w = total - sum(out.values()), sum(weight[s] for s in free)
        above = {s for s in free if w and left * weight[s] / w > 3 * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / w for s in free}
        out |= {s: 3 * sizes[s] for s in above}
        free -= above


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    per = defaultdict(int)
    for r in rows:
        per[r.source] += len((r.text or "").encode().split())
    goal = fill(per)
    out = mixing.op4(docs).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r.doc_id, len((r.text or "").encode().split())) for r in rows)
    taken = defaultdict(int)
    by_size = defaultdict(set)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        by_size[(r.source_size, round(r.target, 6))].add(r.doc_id)
        taken[(r.source_size, round(r.target, 6))] += r.taken
    want = Counter()
    for s, n in per.items():
        want[(n, round(goal[s], 6))] += goal[s]
    assert set(want) == set(taken)
    for k, words in taken.items():
        assert abs(words - want[k]) <= sum(1 for s in per if (per[s], round(goal[s], 6)) == k)
    assert sorted(map(str, out)) == sorted(map(str, mixing.op4(docs).collect()))


def test_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_odd_and_empty(spark):
    check(cases.odd(spark))
    assert mixing.op4(cases.empty(spark)).count() == 0
    assert mixing.op4(cases.odd(spark).where("doc_id in (3, 4, 5)")).agg(F.sum("taken"), F.sum("target")).first() == (0, 0.0)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        x = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(9)).alias("y"))
        got = x.select("id", "y", mixing.permuted(F.col("y"), F.lit(n), F.lit(9), inverse=True).alias("back")).collect()
        assert sorted(r.y for r in got) == list(range(n)) and all(r.id == r.back for r in got)


def test_mixed_texts_hold_the_taken_words(spark):
    docs = cases.odd(spark)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.encode().split())
    want = Counter()
    for r in docs.join(mixing.op4(docs.dropDuplicates(["doc_id"])).select("doc_id", "target"), "doc_id").select("source", "target").distinct().collect():
        want[r.source] = r.target
    assert sum(words.values()) > 0
    assert mixing.mixed(cases.empty(spark)).count() == 0


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def h64(*values):
    """Spark's xxhash64: each value is hashed with the hash of those before it as seed. An int has 4 bytes, a Long 8."""
    seed = 42
    for v in values:
        if v is None:
            continue
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v.v) if isinstance(v, Long) else struct.pack("<i", v)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


class Long:
    def __init__(self, v):
        self.v = v


def permute(x, n, key):
    for r in range(mixing.ROUNDS):
        partner = (h64(Long(key), r) % n - x) % n
        if h64(Long(key), r, Long(max(x, partner))) & 1:
            x = partner
    return x


def dealt(docs):
    """(doc_id, size, text) -> words taken, by dealing the slots of all shards one after another."""
    rows = docs.select("doc_id", "text", "source", mixing.row_hash(docs).alias("tie")).collect()
    size = [len((r.text or "").encode().split()) for r in rows]
    per = defaultdict(int)
    for r, n in zip(rows, size, strict=True):
        per[r.source] += n
    order = sorted(per, key=lambda s: (s is None, s or ""))
    goal, width = fill(per), mixing.BLOCK_WORDS
    n_buckets = max(1, -(-len(rows) // mixing.BUCKET_ROWS))
    streams, wanted, passes = {}, {}, {}
    for sid, s in enumerate(order):
        key = lambda i: (h64(mixing.SEED, *([Long(rows[i].doc_id)] if rows[i].doc_id is not None else []), Long(size[i]), Long(rows[i].tie)) % n_buckets, rows[i].doc_id is not None, rows[i].doc_id or 0, size[i], rows[i].tie)  # noqa: B023, E731
        mine = sorted((i for i, r in enumerate(rows) if r.source == s), key=key)
        words = [i for i in mine for _ in range(size[i])]
        streams[sid] = [words[a : a + width] for a in range(0, len(words), width)]
        want, full = round(goal[s]), min(3, int(Fraction(goal[s]) // per[s])) if per[s] else 0
        rest, slots = (0 if full >= 3 else max(0, min(per[s], want - full * per[s]))), full * len(streams[sid])
        k, left = 0, rest
        while left > 0:
            left -= len(streams[sid][permute(k, len(streams[sid]), h64(mixing.SEED, Long(sid), Long(full)))])
            k += 1
        wanted[sid], passes[sid] = slots + k, (full, rest)
    total = sum(wanted.values())
    bounds = [sid for sid in wanted for _ in range(wanted[sid])]
    drawn = defaultdict(list)
    for place in range(total):
        shard, slot = divmod(place, mixing.SHARD_SLOTS)
        drawn[bounds[h64(mixing.SEED, "draw", Long(shard), Long(slot)) % total]].append((shard, slot))
    used, excess = defaultdict(set), []
    for sid in wanted:
        n = len(drawn[sid])
        for i in range(n):
            k = permute(i, n, h64(mixing.SEED, "settle", Long(sid)))
            used[sid].add(k) if k < wanted[sid] else excess.append((sid, k))
    lacking = [(sid, k) for sid in wanted for k in range(len(drawn[sid]), wanted[sid])]
    assert len(lacking) == len(excess)
    for sid, k in lacking:
        used[sid].add(k)
    taken = Counter()
    for sid in wanted:
        assert used[sid] == set(range(wanted[sid]))
        (full, rest), blocks = passes[sid], streams[sid]
        left = rest
        for k in sorted(used[sid]):
            turn, at = divmod(k, len(blocks))
            words = blocks[permute(at, len(blocks), h64(mixing.SEED, Long(sid), Long(turn)))]
            if turn >= full:
                words, left = words[: max(0, left)], left - len(words)
            taken.update(words)
    return Counter((r.doc_id, n, taken[i]) for i, (r, n) in enumerate(zip(rows, size, strict=True))), {s: Counter(x[0] for x in drawn[s]) for s in drawn}


def test_taken_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 64)
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 32)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 30)
    monkeypatch.setattr(mixing, "_CHUNK", 4)
    monkeypatch.setattr(mixing, "_BINS", 7)
    for docs in (spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 120"), cases.odd(spark)):
        want, drawn = dealt(docs)
        assert Counter((r.doc_id, r.size, r.taken) for r in mixing.op4(docs).collect()) == want
        counts = mixing.shard_counts(mixing.draws(mixing.materialise(mixing.targets(mixing.sized(docs)), "goals"))).collect()
        assert {(r.sid, r.shard): r.n for r in counts} == {(s, shard): n for s, per in drawn.items() for shard, n in per.items()}


def test_counts_are_a_multinomial_draw(spark):
    """Chi-square of the counts of many shards against the goals: neither fixed totals nor another spread."""
    goals = spark.createDataFrame([(0, 600_000), (1, 300_000), (2, 100_000)], "sid long, n_slots long")
    counts = mixing.shard_counts(mixing.draws(goals)).collect()
    shards = {r.shard for r in counts}
    full = [s for s in shards if s < len(shards) - 1]
    n = {(r.shard, r.sid): r.n for r in counts}
    chi = sum((n.get((s, i), 0) - mixing.SHARD_SLOTS * p) ** 2 / (mixing.SHARD_SLOTS * p) for s in full for i, p in enumerate((0.6, 0.3, 0.1)))
    free = 2 * len(full)
    assert abs(chi - free) < 5 * (2 * free) ** 0.5
    assert any(sum(r.n for r in counts if r.sid == i) != g for i, g in ((0, 600_000), (1, 300_000)))


def test_slots_meet_the_goals_and_shards_hold_each_place_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    goals = mixing.materialise(mixing.targets(mixing.sized(docs)), "goals")
    found = mixing.slots(goals)
    n = found.count()
    assert found.select("shard", "slot").distinct().count() == n
    assert {r.sid: r.n for r in found.groupBy("sid").agg(F.count("*").alias("n")).collect()} == {r.sid: r.n_slots for r in goals.where("n_slots > 0").collect()}


def test_plan_takes_from_shards_without_broadcasting_slots(spark, capsys):
    mixing.op4(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert "shard" in plan and "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_extra_columns_with_any_name(spark):
    docs = cases.odd(spark).selectExpr("*", "map('a', 1) as m", "1 as `a.b`", "2 as `c``d`")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert mixing.op4(docs).count() == docs.count()


def test_rows_of_one_doc_id_keep_their_order(spark):
    rows = [(1, f"{w} " * 700, "en", "a", 1) for w in "pqrstuvw"] + [(2, "z " * 9000, "en", "b", 1)]
    first, again = (mixing.mixed(spark.createDataFrame(x, cases.SCHEMA).repartition(3)).collect() for x in (rows, rows[::-1]))
    assert sorted(first) == sorted(again)
