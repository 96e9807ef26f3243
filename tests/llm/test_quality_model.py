import zlib

import numpy as np

from quern.llm import quality_model as qm
from tests.llm import cases

SF = "/root/testdata/sf0.01"


def auc(scores, ys):
    s, y = np.array(scores), np.array(ys)
    a, b = s[y == 1], s[y == 0]
    return ((a[:, None] > b[None, :]).mean() + 0.5 * (a[:, None] == b[None, :]).mean()) if len(a) and len(b) else 1.0


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = {r.doc_id: r for r in qm.op6(docs, labels).collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == ((zlib.crc32(str(d).encode()) % 3 == 1)) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for d, r in out.items())
    held = [(out[r.doc_id], r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert auc([r.score for r, _ in held], [y for _, y in held]) > 0.9
    assert np.mean([r.predicted == y for r, y in held]) > 0.92


def test_held_out_labels_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", qm.F.when(qm.fold_of("doc_id", 3) == 1, 1 - qm.F.col("quality")).otherwise(qm.F.col("quality")).cast("int"))
    a, b = (sorted((r.doc_id, round(r.score, 9)) for r in qm.op6(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_odd_and_empty(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = qm.op6(cases.odd(spark), labels).collect()
    assert len(out) == len(cases.ODD) and len({r.score for r in out}) == 1
    assert qm.op6(cases.empty(spark), labels).count() == 0


def test_isotonic_pools_violators():
    got = qm.isotonic(np.array([0, 5, 1, 9.0]), np.array([10, 10, 10, 10.0]))
    assert (np.diff(got) >= 0).all() and abs(got[1] - got[2]) < 1e-12


def test_sums_weights_and_scores_by_plain_numpy(spark):
    """The whole model from all rows at once, without partial sums."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("documents", "labels"))
    part = lambda d: d.select("doc_id", qm.F.pmod(qm.F.xxhash64("doc_id"), qm.F.lit(qm.PARTS)).alias("p"))
    parts = {r.doc_id: r.p for r in part(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1 and r.doc_id in texts]
    x = np.array([qm.statistics(texts[d]) for d, _ in known])
    y, at = np.array([q for _, q in known], float), np.array([parts[d] for d, _ in known])
    model = qm.Model(x.mean(0), np.sqrt(np.maximum(x.var(0), 1e-6)), np.zeros(0), np.zeros(0))
    z = model.features(x)
    solve = lambda z, y: np.linalg.solve(z.T @ z + qm.RIDGE * len(z) / qm.FEATURES * np.eye(z.shape[1]), z.T @ y)
    fitted = qm.fit(qm.describe(docs).repartition(3), labels)
    assert np.allclose(fitted.weights, solve(z, y), atol=1e-6)
    raw = np.empty(len(y))
    for k in range(qm.PARTS):  # each row is calibrated by weights that have not seen it
        raw[at == k] = z[at == k] @ solve(z[at != k], y[at != k])
    bins = qm.bins_of(raw)
    steps = qm.isotonic(np.bincount(bins, weights=y, minlength=qm.BINS), np.bincount(bins, minlength=qm.BINS))
    assert np.allclose(fitted.steps, steps, atol=1e-6)
    model.weights, model.steps = solve(z, y), steps
    want = dict(zip(texts, np.clip(model.score(np.array([qm.statistics(v) for v in texts.values()])), 0, 1), strict=True))
    assert all(abs(r.score - want[r.doc_id]) < 1e-6 for r in qm.op6(docs, labels).collect())
