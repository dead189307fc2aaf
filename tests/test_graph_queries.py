"""Queries over the neighbour graph on points too many to be broadcast."""

import pytest

from chainframe.operators import neighbors
from chainframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
NAMES = [
    "neighbor_topk_distances",
    "velocity_kernel_cosine_whole",
    "kernel_sum",
    "velocity_kernel_cosine",
    "softmax_scale_whole",
    "velocity_kernel_dot",
    "cross_boundary_correctness_whole",
    "velocity_kernel_custom",
    "cross_boundary_correctness",
    "velocity_kernel_dot_whole",
    "velocity_kernel_correlation",
    "kernel_product",
    "connected_components",
    "knn_moments_whole",
    "classes_by_size",
    "label_propagation",
]


@pytest.mark.parametrize("name", NAMES)
def test_points_stream_by_and_rows_stay(spark, monkeypatch, name):
    """The rows are those of broadcast points, and no task gets a block of points whole; before, each pair of blocks was one Python group."""
    usual, graphs = neighbors.knn, []

    def streamed(points, k):
        graphs.append(usual(points, k, block=90, broadcast_bytes=0))
        return graphs[-1]

    rows = lambda: sorted(map(tuple, QUERIES[name](spark, SF).collect()), key=str)
    every = rows()
    monkeypatch.setattr(neighbors, "knn", streamed)
    assert rows() == every and every
    plans = [g._jdf.queryExecution().toString() for g in graphs]
    assert plans and all("MapInArrow" in p and "FlatMapGroups" not in p for p in plans)
