"""Queries are held together against a batch's cases, however many cells these lie in."""

import numpy as np
import pandas as pd

from awardry.operators import search, vector_cells


def test_products_of_a_batch_do_not_grow_with_its_cells(monkeypatch):
    rng = np.random.default_rng(5)
    vectors, calls, block_best = rng.normal(size=(600, 8)), [], search.block_best
    vectors[3] = 0
    m = vector_cells.unit(list(vectors))
    cell = np.where(np.arange(600) == 3, vector_cells.ZERO, rng.integers(0, 200, 600))
    numbers = np.unique(cell)
    batch = pd.DataFrame({"id": rng.permutation(600), "case_name": [f"N{i % 70}" for i in range(600)], "name": [f"n{i % 70}" for i in range(600)], "vec": list(vectors), "rest": (rng.random(600) / 5).round(2), "cell": cell})
    monkeypatch.setattr(search, "block_best", lambda *a: calls.append(len(a[0])) or block_best(*a))
    ids = np.arange(40) * 10
    few = np.isin(numbers, [*range(50), vector_cells.ZERO])
    parts = [(0, 16, np.ones(len(numbers), bool)), (16, 32, few), (32, 40, np.zeros(len(numbers), bool))]
    got = search.best_so_far(search.batch_best(batch, numbers, parts, ids, m[:40], 0.55, 5), 5)
    assert calls == [600, int(np.isin(cell, numbers[few]).sum())]
    for q in range(32):
        rows = batch.assign(combined=np.round(m @ m[q] * 0.55 + batch["rest"], 9))
        rows = rows if q < 16 else rows[np.isin(cell, numbers[few])]
        want = rows.sort_values(["combined", "id"], ascending=[False, True]).drop_duplicates("name").head(5)
        own = got[got["query_id"] == ids[q]].sort_values(["combined", "id"], ascending=[False, True])
        assert own["id"].tolist() == want["id"].tolist() and np.allclose(own["combined"], want["combined"])
    assert set(got["query_id"]) == set(ids[:32])
    assert list(search.batch_best(batch.head(0), numbers, parts, ids, m[:40], 0.55, 5)) == []
