"""Small tables of components, clusters and rules for the tests of what works on model-sized tables."""

from stratamix.operators import merge

CROSSINGS = [(1, 0.5, 0.0, 1.0, 0.5, 2.0, 1.0), (2, 0.7, 0.0, 0.5, 0.3, 2.0, 0.8), (3, 0.9, 0.0, 0.1, 0.1, 3.0, 0.1), (4, 0.5, 0.0, 0.1, 0.5, 3.0, 0.3), (5, 0.95, 0.0, 1.0, 0.05, 1.0, 0.5), (6, 0.99, 0.0, 0.6, 0.01, 0.3, 0.3)]
COMPONENTS = [
    (1, 0.30, [0.2, 1.1, 2.4], [0.10, 0.20, 0.15]), (2, 0.20, [1.8, 0.3, 2.2], [0.12, 0.10, 0.30]), (3, 0.15, [0.1, 1.4, 2.6], [0.05, 0.25, 0.10]),
    (4, 0.25, [2.6, 1.9, 2.1], [0.40, 0.11, 0.21]), (5, 0.10, [1.6, 0.2, 2.9], [0.22, 0.05, 0.17]),
]
MARKERS, MARKER_CUTS = ["m1", "m2", "m3"], {"m1": [1.0, 2.5], "m2": [1.0]}
CLUSTERS = [(1, 1, 1, 1), (2, 3, 2, 1), (3, 2, 1, 2), (4, 3, 1, 3), (5, 2, 2, 3), (6, 1, 3, 1)]
RULES = [(1, "alpha", "hi", "hi"), (2, "beta", "hi", "lo"), (3, "gamma", "lo", "hi"), (4, "delta", "hi", "dc")]


def components(spark):
    rows = [(k, p, m, [[v[i] if i == j else 0.0 for j in range(3)] for i in range(3)]) for k, p, m, v in COMPONENTS]
    return spark.createDataFrame(rows, "component int, pro double, mean array<double>, cov array<array<double>>")


def mapping(spark):
    return merge.component_clusters(components(spark), MARKERS, MARKER_CUTS)


def clusters(spark):
    return spark.createDataFrame(CLUSTERS, "cluster int, m1 int, m2 int, m3 int")


def rules(spark):
    return spark.createDataFrame(RULES, "rule_order int, label string, m1 string, m2 string")
