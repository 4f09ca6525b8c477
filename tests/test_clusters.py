"""Density clusters of one frame: against lists of all neighbours, in cells and in a matrix, and of a crowded frame."""

import time

import numpy as np

from vigil.operators import zones


def by_lists(xy, eps, least):
    """Cores reach their neighbours, from the first core on; what is reached first is taken."""
    near = [[j for j, q in enumerate(xy) if (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 <= eps * eps] for p in xy]
    free, sizes = set(range(len(xy))), []
    for start in range(len(xy)):
        if len(near[start]) >= least and start in free:
            reached, todo = {start}, [start]
            while todo:
                for j in near[todo.pop()]:
                    if j in free and j not in reached:
                        reached.add(j)
                        if len(near[j]) >= least:
                            todo.append(j)
            free -= reached
            sizes.append(len(reached))
    return sizes


def test_clusters_equal_lists(monkeypatch):
    rng = np.random.default_rng(8)
    for k in range(150):
        xy = rng.integers(0, [12, 40, 300][k % 3], (rng.integers(0, 70), 2)) * [1.0, 0.1, 7.3][k % 2]
        if k % 10 == 0 and len(xy) > 4:
            xy[2], xy[3] = (np.nan, 1.0), (np.inf, 2.0)
        for eps in (0.0, 0.3, 1.0, 2.0, 7.3, 15.0):
            for least in (1, 2, 3, 6):
                want = by_lists(xy.tolist(), eps, least)
                for distances in (1 << 20, 5):
                    monkeypatch.setattr(zones, "DISTANCES", distances)
                    assert zones.cluster_sizes(xy, eps, least) == want


def test_a_crowded_frame_is_quick():
    """12,000 points of one frame, some 800 of them near each: lists of neighbours would hold ten million numbers."""
    xy = np.random.default_rng(1).integers(0, 1000, (12_000, 2)).astype(float)
    far = np.array([[5000.0 + 400 * k, 0.0] for k in range(50)])
    began = time.process_time()
    assert zones.cluster_sizes(np.concatenate((far, xy)), 150.0, 2) == [12_000]
    assert time.process_time() - began < 1
