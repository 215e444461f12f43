import zlib
from collections import Counter

import numpy as np
import pytest

from thresher.llm.sharding import communication_matrix, draw_hypergeometric, shuffle_into_shards


def test_matrix_is_exact():
    matrix = np.array(communication_matrix([10, 0, 7, 3], 6, seed=1))
    assert matrix.sum(axis=1).tolist() == [10, 0, 7, 3]
    assert sorted(matrix.sum(axis=0).tolist()) == [3, 3, 3, 3, 4, 4]


def test_large_populations_are_drawn_around_the_mean():
    rng = np.random.default_rng(0)
    x = [draw_hypergeometric(rng, 4 * 10**9, 6 * 10**9, 10_000) for _ in range(200)]
    assert abs(np.mean(x) - 4000) < 15 and 35 < np.std(x) < 65


@pytest.mark.parametrize("n", [0, 1, 3, 997])
def test_shards(docs_of, prose, n):
    rows = [(k if k % 10 else None, None if k % 7 == 0 else prose(k, k % 30)) for k in range(n)] + [(5, "same")] * (30 if n > 3 else 0)
    found = shuffle_into_shards(docs_of(rows), shards=4, parts=8, rows_per_block=50).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows
    )
    sizes = Counter(r["shard"] for r in found)
    assert max(sizes.values(), default=0) - min((sizes[k] for k in range(4)), default=0) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))


def test_order_is_mixed(docs_of):
    found = shuffle_into_shards(docs_of([(k, "x") for k in range(2000)]), shards=2, parts=8).collect()
    first = [r["doc_id"] for r in sorted(found, key=lambda r: r["slot"]) if r["shard"] == 0]
    assert abs(np.corrcoef(range(len(first)), first)[0, 1]) < 0.1
