"""Trust is propagated until what still moves is below tolerance."""

import numpy as np

from sparrowdex.llm import url_filter


def test_a_chain_of_over_20_hosts_and_a_cycle_converge(spark):
    n = 40
    edges = [(f"h{i}", f"h{i + 1}", 1) for i in range(n - 1)] + [("h39", "h30", 1)]
    seeds = [("h0", 1.0, 0.0), ("h39", 0.0, 1.0)]
    got = {r.host: (r.trust, r.distrust) for r in url_filter.propagate(spark.createDataFrame(edges, "src string, dst string, n int"), spark.createDataFrame(seeds, "host string, trust double, distrust double")).collect()}
    m = np.zeros((n, n))
    for a, b, k in edges:
        m[int(a[1:]), int(b[1:])] = k
    for k, (mat, seed) in enumerate([(m, 0), (m.T, n - 1)]):
        w = mat / np.maximum(mat.sum(axis=1, keepdims=True), 1)
        r = np.linalg.solve(np.eye(n) - 0.85 * w.T, 0.15 * np.eye(n)[seed])
        assert max(abs(got.get(f"h{i}", (0, 0))[k] - r[i]) for i in range(n)) < 1e-6
    assert got["h5"][1] > 0
