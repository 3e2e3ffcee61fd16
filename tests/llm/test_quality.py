import binascii

import numpy as np

from sparkloom.llm import quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = quality.op5_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    for label in (0, 1):
        of = [r for r in held if r.quality == label]
        assert sum(r.predicted == label for r in of) / len(of) > 0.9
    assert all(0 < r.score < 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_only_training_labels_count(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", __import__("pyspark.sql.functions", fromlist=["f"]).when(quality.held_out(), 1 - labels.quality).otherwise(labels.quality))
    a, b = ({r.doc_id: r.score for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    want = {i for i, s in a.items() if s >= 0.3}
    assert {r.doc_id for r in kept.collect()} == want


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "", 9.0), (2, None, 9.0), (None, "x", 9.0), (3, "y " * 50000, 9.0), (3, "z", 9.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (2, 1), (77, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 5 and all(0 < r.score < 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert quality.classify(none, labels).count() == 0
    assert quality.accepted(docs, labels.limit(0)).count() == 5


def test_cholesky_scores_are_log_densities():
    rng = np.random.default_rng(1)
    n = quality.N_STATS
    means, factors, logdets, want = [], [], [], []
    x = rng.normal(size=(5, n))
    for _ in range(2):
        m, a = rng.normal(size=n) * 0.1, rng.normal(size=(n, n)) * 0.1 + np.eye(n)
        s = a @ a.T
        lower = np.linalg.cholesky(s)
        means.append(m)
        factors.append(np.linalg.inv(lower))
        logdets.append(np.linalg.slogdet(s)[1])
        want.append(-0.5 * (np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(s), x - m) + logdets[-1]))
    got = quality.Discriminant(0.5, tuple(means), tuple(factors), tuple(logdets)).scores(x)
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(0.5 + want[1] - want[0], -30, 30))))
