"""Kernels and learned pieces by their invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectorloom.config import IndexConfig, SearchConfig
from vectorloom.functions import kernels as K
from vectorloom.operators import quantize
from vectorloom.operators.quantiles import ordered, value_of

floats = st.floats(-1e6, 1e6, allow_nan=False)


@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 1), st.integers(0, 255)), min_size=1, max_size=9))
@settings(max_examples=50, deadline=None)
def test_pack_unpack(rows):
    bits = np.array([3, 1, 0, 8])
    codes = np.array([(a, b, 0, c) for a, b, c in rows], np.int16)
    assert (K.unpack_codes(K.pack_codes(codes, bits), bits) == codes).all()


@given(st.lists(floats, min_size=2, max_size=40))
@settings(max_examples=50, deadline=None)
def test_ordered_keys(values):
    x = np.array(values) + 0.0
    key = ordered(x)
    assert (x[np.argsort(key, kind="stable")] == np.sort(x)).all()
    assert [value_of(int(k)) for k in key] == x.tolist()


@given(st.integers(0, 1000))
@settings(max_examples=30, deadline=None)
def test_bounds_bracket_distance(seed):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((50, 3))
    bounds = [np.concatenate([[c.min() - 0.001], np.sort(c)[[12, 25, 37]], [c.max() + 0.001]]) for c in x.T]
    codes = K.cells(x, bounds)
    assert all((b[codes[:, j]] <= x[:, j]).all() and (x[:, j] <= b[codes[:, j] + 1]).all() for j, b in enumerate(bounds))
    for q in (x[0], rng.standard_normal(3) * 4):
        true = K.distances(x, q)
        low, high = K.bounds_of(codes, K.bound_tables(q, bounds))
        assert (low <= true + 1e-9).all() and (true <= high + 1e-9).all()
    low, high = K.bounds_of(codes, K.symmetric_tables(x[0], bounds))
    assert (low <= K.distances(x, x[0]) + 1e-9).all() and (K.distances(x, x[0]) <= high + 1e-9).all()


def test_top_breaks_ties_by_id():
    assert K.top(np.array([1.0, 0.0, 1.0, 1.0]), np.array([9, 8, 3, 5]), 3).tolist() == [1, 2, 3]


def test_greedy_allocation():
    cells = quantize.greedy_cells([16.0, 4.0, 0.5, 0.0], 6, 1000)
    assert sum(int(np.log2(c)) for c in cells) == 6 and cells[0] >= cells[1] >= cells[2] and cells[3] == 1
    assert quantize.greedy_cells([9.0], 20, 10_000) == [255]
    assert quantize.greedy_cells([9.0, 1.0], 10, 5) == [4, 4]
    assert quantize.greedy_cells([0.0, 0.0], 4, 100) == [1, 1]


def test_lloyd_never_worse():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 500), rng.normal(9, 0.1, 50)])
    b = np.concatenate([[x.min() - 1], np.quantile(x, [0.25, 0.5, 0.75]), [x.max() + 1]])
    assert quantize.squared_error(x, quantize.lloyd(x, b)) < quantize.squared_error(x, b)


def test_constant_dimension():
    x = np.ones((9, 1))
    assert K.cells(x, [np.array([0.999, 1.001])]).tolist() == [[0]] * 9


@pytest.mark.parametrize("bad", [dict(k=0), dict(mode="x"), dict(percent=0), dict(centroid_factor=0.5), dict(bound="x")])
def test_search_settings(bad):
    with pytest.raises(ValueError):
        SearchConfig(**bad)
    with pytest.raises(ValueError):
        IndexConfig(partitions=0)
