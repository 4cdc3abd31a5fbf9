"""Clusters of vectors with nulls, ties, copies and odd sizes, against whole-number rounds in plain Python."""

import hashlib
import math

from lexmill.llm import kmeans

SCHEMA = "vec_id long, embedding array<float>, label int, q string, n string, cluster string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "q", "n", "c") for i, v in rows], SCHEMA)


def plain(rows, clusters, rounds):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-kmeans.LARGEST, min(kmeans.LARGEST, math.floor(256 * x))) for x in v]))
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(q) for _, q in sorted(kept, key=key)[:clusters]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        for k, qs in groups.items():
            centroids[k] = [sum(x) // len(qs) for x in zip(*qs, strict=True)]
    found = [(i, *near(q)) for i, q in kept]
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = [sum(d for _, d, c in found if c == k) for k in range(len(centroids))]
    return sorted(((i, k, d, own[k], sum(own), shas[k]) for i, d, k in found), key=repr)


def vector(*head):
    return [float(x) for x in head] + [0.0] * (64 - len(head))


ROWS = [
    *[(i, vector(i % 7 / 3, (i * i) % 11 / 5, -i / 100)) for i in range(120)],
    *[(1000 + i, vector(1.5, -2.25)) for i in range(200)],
    (5, vector(9.0)), (5, vector(-9.0)), (5, vector(-9.0)), (None, vector(0.5)), (None, vector(0.25)), (6, vector(1e30, -1e30)), (7, vector(0.001, -0.001)),
    (8, None), (9, []), (10, [1.0] * 63), (11, [1.0] * 65), (12, [1.0] * 63 + [None]), (13, [1.0] * 63 + [float("nan")]), (14, [float("-inf")] * 64),
]


def test_rounds(spark):
    out = sorted((tuple(r) for r in kmeans.cluster_report(frame(spark, ROWS).repartition(5)).collect()), key=repr)
    assert out == plain(ROWS, 40, 5)


def test_equal_centroids_leave_the_later_empty(spark):
    rows = [(i, vector(1.0)) for i in range(60)] + [(i, vector(4.0)) for i in range(60, 65)]
    out = sorted((tuple(r) for r in kmeans.cluster_report(frame(spark, rows), clusters=50).collect()), key=repr)
    assert out == plain(rows, 50, 5)


def test_few_and_no_vectors(spark):
    rows = [(1, vector(1.0)), (2, vector(2.0)), (3, None)]
    out = sorted((tuple(r) for r in kmeans.cluster_report(frame(spark, rows)).collect()), key=repr)
    assert out == plain(rows, 40, 5) and [r[2] for r in out] == [0, 0]
    assert kmeans.cluster_report(frame(spark, [(1, None)])).collect() == []
    assert kmeans.cluster_report(frame(spark, [])).collect() == []


def test_distinct_vectors_are_compared_once(spark):
    found = kmeans.cluster(frame(spark, ROWS))
    assert found.assigned.count() == found.kept.select("q").distinct().count() < found.kept.count()
    assert found.assigned.agg({"n": "sum"}).first()[0] == found.kept.count()
