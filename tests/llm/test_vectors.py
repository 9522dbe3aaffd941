from __future__ import annotations

import numpy as np

from deltaloom.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id int, v string"


def brute(rows, threshold):
    good = {}
    for i, e, label, *_ in rows:
        if i is None or label is None or not e or any(x is None or not np.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, np.float32).astype(float)
        v /= np.linalg.norm(v)
        good[i] = (label, v)
    near = {i: {j for j in good if j != i and good[j][0] == good[i][0] and len(good[i][1]) == len(good[j][1]) and good[i][1] @ good[j][1] >= threshold} for i in good}
    out = []
    for i, *_ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = None if i is None else min(seen)
        out.append((i, len(near.get(i, ())), least, i is not None and least == i))
    return sorted(out, key=str)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        base = rng.normal(size=24)
        for _ in range(60 if c == 0 else 6):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.33])).tolist(), c % 3, 1, "x"))
    rows += [(len(rows) + i, rng.normal(size=24).tolist(), int(rng.integers(0, 3)), 1, "x") for i in range(150)]
    n = len(rows)
    rows += [(n, None, 1, 1, "x"), (n + 1, [], 1, 1, "x"), (n + 2, [0.0] * 24, 1, 1, "x"), (n + 3, [float("nan")] * 24, 1, 1, "x"), (n + 4, rows[0][1], None, 1, "x"), (n + 5, [None] + rows[0][1][1:], 0, 1, "x"), (n + 6, rows[0][1][:5], 0, 1, "x"), (None, rows[0][1], 0, 1, "x"), (n + 7, [float("inf")] + rows[0][1][1:], 0, 1, "x"), (n + 8, rows[0][1], 0, 1, "x"), (n + 9, [x * 1e30 for x in rows[0][1]], 0, 1, "x"), (n + 10, [x * 1e-20 for x in rows[0][1]], 0, 1, "x"), (5, rows[5][1], rows[5][2], 1, "x")]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.recall for r in got} <= {1.0}
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 0.93)


def test_empty(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = vectors.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0], 1, 1, "x"), (2, None, 1, 1, "x")], SCHEMA)).collect()
    assert sorted(tuple(r)[:4] for r in alone) == [(1, 0, 1, True), (2, 0, 2, True)]


def grouped(rng, sizes, noise, cosine=0.95, width=64):
    """Rows of one label: pairs of groups of these sizes, the centres of each pair at this cosine."""
    rows = []
    for n, m in sizes:
        x, y = np.linalg.qr(rng.normal(size=(width, 2)))[0].T
        for size, centre in ((n, x), (m, cosine * x + (1 - cosine**2) ** 0.5 * y)):
            rows += [(len(rows) + i, (centre + noise * rng.normal(size=width)).tolist(), 1, 1, "x") for i in range(size)]
    return rows


def test_links_between_saturated_groups(spark):
    rng = np.random.default_rng(2)
    rows = grouped(rng, [(250, 250)], 0.0) + [(1000 + i, *r[1:]) for i, r in enumerate(grouped(rng, [(250, 250), (20, 20)], 1e-3))]
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 0.93)


def test_a_dense_group_hides_no_loss(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, *r[1:]) for i, r in enumerate(grouped(rng, [(200, 0)], 1e-3) + sum((grouped(rng, [(1, 1)], 1e-3) for _ in range(30)), []))]
    whole = vectors.refined

    def lossy(graph, rows, k, turn):
        graph = whole(graph, rows, k, turn)
        return graph.where("a < 200 AND b < 200") if k == vectors.K else graph

    monkeypatch.setattr(vectors, "refined", lossy)
    got = vectors.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 0.93)
