import math

import numpy as np
import pytest

from mergeloom.llm.grid_order import embedding_components


def brute(rows, least):
    ok = {}
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = (np.array(v, float), label)
    links = {i: set() for i, _, _ in rows}
    for i, (u, a) in ok.items():
        for j, (v, b) in ok.items():
            if i < j and a == b and len(u) == len(v) and u @ v / math.sqrt(u @ u) / math.sqrt(v @ v) >= least:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += [y for y in links[todo.pop()] if y not in seen and not seen.add(y)]
        out.append((i, len(links[i]), min(seen), min(seen) == i))
    return sorted(out)


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(int(rng.integers(1, 30))):
            v = centre + rng.normal(size=8) * rng.choice([0.02, 0.08, 0.2])
            rows.append((len(rows), [float(np.float32(x)) for x in v * rng.uniform(0.5, 2)], int(c % 3)))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(40)]  # exact copies
    dense = rng.normal(size=8)
    rows += [(len(rows) + k, [float(np.float32(x)) for x in dense + rng.normal(size=8) * 0.004], 1) for k in range(60)]  # all linked
    n = len(rows)
    odd = [None, [0.0] * 8, [1.0, float("nan")] + [0.0] * 6, [float("inf")] * 8, [None] * 8, [1.0, 2.0], [2.0, 4.0]]
    return rows + [(n + k, v, 0) for k, v in enumerate(odd)] + [(n + 20, rows[0][1], None)]


@pytest.mark.parametrize(("block_rows", "leaf", "tile"), [(512, 64, 8), (7, 2, 2), (5, 8, 1)])
def test_against_brute_force(spark, block_rows, leaf, tile):
    rows = vectors()
    table = spark.createDataFrame([(i, v, y, 1) for i, v, y in rows], "vec_id bigint, embedding array<float>, label int, node int")
    got = embedding_components(table, block_rows=block_rows, leaf=leaf, tile=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == brute(rows, 0.98)


def test_empty_table(spark):
    assert embedding_components(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_very_small_and_very_large_components(spark):
    rows = [(0, [1e-170, 0.0]), (1, [3e-170, 1e-172]), (2, [1e300, 1e300]), (3, [1.7e308, 1.6e308]), (4, [5e-324, 0.0]), (5, [0.0, 1e-300]), (6, [-1e-170, 0.0]), (None, [1.0, 1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, label int")
    got = [(r.vec_id, r.n_links, r.component_id) for r in embedding_components(table).collect()]
    assert sorted(got, key=str) == [(0, 2, 0), (1, 2, 0), (2, 3, 2), (3, 3, 2), (4, 2, 0), (5, 0, 5), (6, 0, 6), (None, 3, 2), (None, 3, 2)]
