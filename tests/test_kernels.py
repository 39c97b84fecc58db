"""Properties of the block updates."""

import numpy as np
import pytest

from voxelspark.functions import kernels as k

RNG = np.random.default_rng(5)


@pytest.mark.parametrize("shape", [(1, 9, 11), (5, 6, 7), (1, 1, 8)])
def test_poisson_inverts_the_laplacian(shape):
    u = RNG.normal(size=shape)
    f = sum(k.backward(k.forward(u, ax), ax) for ax in range(3) if shape[ax] > 1)
    assert np.allclose(k.poisson(f), u - u.mean())


def test_backward_is_the_adjoint_of_forward():
    u, p = RNG.normal(size=(4, 5, 6)), RNG.normal(size=(4, 5, 6))
    p[:, :, -1] = 0
    assert np.isclose((k.forward(u, 2) * p).sum(), (u * k.backward(p, 2)).sum())


@pytest.mark.parametrize("order,data", [(1, "l1"), (1, "l2"), (2, "l1"), (2, "l2"), (3, "l1"), (5, "l1")])
@pytest.mark.parametrize("shape", [(1, 8, 9), (4, 5, 6)])
def test_a_constant_image_stays(order, data, shape):
    u, v = k.solve(k.Variation(order, (1.0, 2.0, 3.0, 4.0, 5.0)[: max(order, 1)], 1.0, data), [np.full(shape, 3.0)], 20)
    assert np.allclose(u, 3) and all(np.allclose(a, 0) for a in v)


def test_a_heavy_data_term_keeps_the_image():
    f = RNG.normal(size=(1, 12, 13))
    u, _ = k.solve(k.Variation(2, (1.0, 2.0), 1e9), [f], 30)
    assert np.allclose(u, f)


def test_levels_differ_by_their_first_gradient():
    f = RNG.normal(size=(1, 10, 10))
    a, _ = k.solve(k.Variation(3, (0.3, 0.6, 0.9), 0.5), [f], 40)
    b, _ = k.solve(k.Variation(3, (0.3, 0.6, 0.9), 0.5, first_gradient="forward"), [f], 40)
    assert not np.allclose(a, b)


def test_outside_the_mask_nothing_moves():
    f, mask = RNG.normal(size=(1, 10, 10)), (RNG.random((1, 10, 10)) > 0.4).astype(float)
    u, v = k.solve(k.Variation(2, (0.3, 0.6), 0.5, masked=True), [f, mask], 30)
    assert np.array_equal(u[mask < 1], f[mask < 1]) and not np.allclose(u, f) and all((a[mask < 1] == 0).all() for a in v)


def test_splines_go_through_their_values():
    c = k.spline_coefficients(RNG.normal(size=9).copy())
    padded = np.concatenate([[c[1]], c, [c[-2]]])
    values = (padded[:-2] + 4 * padded[1:-1] + padded[2:]) / 6
    assert np.allclose(k.spline_coefficients(values.copy()), c)
