"""Components are the same on the driver and by stars, and near-dedup takes few jobs of the driver."""

from __future__ import annotations

import numpy as np
import pytest

from winnowlake.llm import simhash


def plain(edges: list[tuple[int, int]]) -> dict[int, int]:
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
    return {x: r for x, r in root.items() if x != r}


def graphs() -> dict[str, list[tuple[int, int]]]:
    rng = np.random.default_rng(7)
    far = rng.integers(-(2**63), 2**63 - 1, 300).tolist()
    return {
        "none": [], "loop": [(4, 4)], "chain": [(k + 1, k) for k in range(200)], "zigzag": [(k, 1000 - k) for k in range(200)] + [(k + 1, 1000 - k) for k in range(199)],
        "hub is the largest": [(10_000, k) for k in range(300)], "hub is the smallest": [(k, -5) for k in range(300)],
        "random": [(far[x], far[y]) for x, y in rng.integers(0, 300, (220, 2)).tolist()], "repeated": [(2, 1), (1, 2), (2, 1), (3, 3), (9, 2)],
    }


@pytest.mark.parametrize("name", graphs())
def test_smallest_reached(name):
    edges = graphs()[name]
    u, v = np.array(edges, np.int64).reshape(-1, 2).T
    node, root = simhash.smallest_reached(u, v)
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == plain(edges) and len(set(node.tolist())) == len(node)


def test_components_on_the_driver_equal_those_by_stars(spark):
    edges = [e for k, part in enumerate(graphs().values()) for e in ((u // 16 * 16 + k, v // 16 * 16 + k) for u, v in part)]
    table = spark.createDataFrame(edges, "u long, v long").repartition(3)
    want = sorted(plain(edges).items())
    for most in (len(edges), len(edges) - 1):  # the bound itself is still the driver's
        assert sorted(map(tuple, simhash.components(table, most_local=most).collect())) == want
    for most in (10, 0):
        assert simhash.components(table.limit(0), most_local=most).count() == 0


def test_dedup_takes_few_jobs_and_keeps_the_smallest_id(spark, monkeypatch):
    words = np.random.default_rng(1).integers(0, 5000, (20, 400)).astype(str)
    texts = [" ".join(x) for x in words] + [" ".join([*x[:-1], y]) for x in words for y in "abc"]
    rows = [(k, texts[k % 80], k) for k in range(400, 0, -1)] + [(None, texts[3], 0), (None, "only here once", 0), (None, None, 0), (7, texts[7], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(5)
    spark.sparkContext.setJobGroup("few-jobs", "")
    try:
        kept = sorted(simhash.deduplicated(docs).collect(), key=str)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-jobs"))
    fp = [simhash.fingerprint((t or "").encode()) for _, t, _ in rows]
    group = plain([(x, y) for x in set(fp) for y in set(fp) if (x ^ y).bit_count() <= 4])
    assert len(group) > 10
    best: dict[int, tuple] = {}
    for x, (k, _, _) in zip(fp, rows, strict=True):
        best[group.get(x, x)] = min(best.get(group.get(x, x), (2, 0)), (k is None, k or 0))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(best.values())
    assert jobs <= 24, jobs  # with stars, or a join of all rows with their groups: more
    monkeypatch.setattr(simhash, "components", lambda edges, f=simhash.components: f(edges, most_local=-1))
    assert sorted(simhash.deduplicated(docs).collect(), key=str) == kept
