"""Numpy updates on one block of voxels, shaped (z, y, x), or on a stack of blocks, (n, z, y, x); depth 1 is treated as 2-D."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np


def axes_of(a: np.ndarray) -> tuple[int, ...]:
    """Array axes of x, y and, with depth, z."""
    return (-1, -2) if a.shape[-3] == 1 else (-1, -2, -3)


def forward(a: np.ndarray, axis: int) -> np.ndarray:
    out = np.zeros_like(a)
    lo, hi = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    lo[axis], hi[axis] = slice(None, -1), slice(1, None)
    out[tuple(lo)] = a[tuple(hi)] - a[tuple(lo)]
    return out


def backward(a: np.ndarray, axis: int) -> np.ndarray:
    """previous - own; minus own at the border."""
    out = -a
    lo, hi = [slice(None)] * a.ndim, [slice(None)] * a.ndim
    lo[axis], hi[axis] = slice(None, -1), slice(1, None)
    out[tuple(hi)] += a[tuple(lo)]
    return out


def _shifts(a: np.ndarray, size: int):
    """(dx, dy, dz, slices of the reading voxels, slices of their taps) over the last three axes."""
    half = size // 2
    span = range(-half, size - half)
    for dz in span:
        for dy in span:
            for dx in span:
                own, tap, empty = [], [], False
                for d, n in zip((dz, dy, dx), a.shape[-3:], strict=True):
                    lo, hi = max(0, -d), min(n, n - d)
                    empty |= lo >= hi
                    own.append(slice(lo, hi))
                    tap.append(slice(lo + d, hi + d))
                if not empty:
                    yield dx, dy, dz, (..., *own), (..., *tap)


def non_local_gradient(a: np.ndarray, size: int, sigma: float) -> np.ndarray:
    at = np.arange(size) - size // 2
    total = np.exp(-(at[:, None, None] ** 2 + at[None, :, None] ** 2 + at[None, None, :] ** 2) / sigma).sum()
    out = np.zeros_like(a)
    for dx, dy, dz, own, tap in _shifts(a, size):
        out[own] += np.abs(a[own] - a[tap]) * (np.exp(-(dx * dx + dy * dy + dz * dz) / sigma) / total)
    return out


def bilateral(a: np.ndarray, size: int, sigma_space: float, sigma_value: float) -> np.ndarray:
    total, weight = np.zeros_like(a), np.zeros_like(a)
    for dx, dy, dz, own, tap in _shifts(a, size):
        d = a[own] - a[tap]
        w = np.exp(-(dx * dx + dy * dy + dz * dz) / sigma_space) * np.exp(-d * d / sigma_value)
        total[own] += w * a[tap]
        weight[own] += w
    return total / weight


@dataclass(frozen=True)
class Variation:
    """A denoising problem. order 1: total variation; 2 and more: total generalised variation of that order.

    alpha[0] bounds the dual of the gradient, alpha[1] that of the symmetrised derivative, alpha[2:] those above.
    data: "l1" or "l2". first_gradient: the difference of the lowest level above 2, "backward" or "forward"."""

    order: int
    alpha: tuple[float, ...]
    weight: float
    data: str = "l1"
    first_gradient: str = "backward"
    masked: bool = False
    weights: bool = False  # the second input field has a weight for each voxel


class Solver:
    """State arrays: input(s), u, u over-relaxed, then p, v, v over-relaxed, q, and w, w over-relaxed, r by level."""

    def __init__(self, problem: Variation, dims: int):
        self.p, self.dims = problem, dims
        self.pairs = list(combinations(range(dims), 2))
        self.tensor = dims + len(self.pairs)
        self.inputs = 1 + problem.weights + problem.masked
        self.step = 1 / np.sqrt(8 if problem.order == 1 else 20)
        self.levels = max(0, problem.order - 2)

    def start(self, fields: list[np.ndarray]) -> list[np.ndarray]:
        n = self.dims + (2 * self.dims + self.tensor) * (self.p.order > 1) + 3 * self.tensor * self.levels
        return [*fields, fields[0].copy(), fields[0].copy(), *(np.zeros_like(fields[0]) for _ in range(n))]

    def split(self, s: list[np.ndarray]):
        at = self.inputs

        def take(n: int) -> list[np.ndarray]:
            nonlocal at
            at += n
            return s[at - n : at]

        (u,), (ubar,), p = take(1), take(1), take(self.dims)
        v, vbar, q = (take(self.dims), take(self.dims), take(self.tensor)) if self.p.order > 1 else ([], [], [])
        levels = [(take(self.tensor), take(self.tensor), take(self.tensor)) for _ in range(self.levels)]
        return u, ubar, p, v, vbar, q, levels

    def _project(self, x: list[np.ndarray], alpha: float, tensor: bool) -> list[np.ndarray]:
        norm = sum((2 if tensor and i >= self.dims else 1) * a * a for i, a in enumerate(x))
        scale = np.maximum(1.0, np.sqrt(norm) / alpha)
        return [a / scale for a in x]

    def _symmetric(self, v: list[np.ndarray], ax: tuple[int, ...], d) -> list[np.ndarray]:
        """Derivatives of a vector: own ones, then the means of the mixed ones."""
        return [d(v[i], ax[i]) for i in range(self.dims)] + [(d(v[i], ax[j]) + d(v[j], ax[i])) / 2 for i, j in self.pairs]

    def _levelwise(self, w: list[np.ndarray], ax: tuple[int, ...], d) -> list[np.ndarray]:
        """Derivatives of a tensor, each component by its own axes."""
        return [d(w[i], ax[i]) for i in range(self.dims)] + [(d(w[self.dims + k], ax[i]) + d(w[self.dims + k], ax[j])) / 2 for k, (i, j) in enumerate(self.pairs)]

    def _contract(self, q: list[np.ndarray], ax: tuple[int, ...]) -> list[np.ndarray]:
        out = [forward(q[i], ax[i]) for i in range(self.dims)]
        for k, (i, j) in enumerate(self.pairs):
            out[i] = out[i] + forward(q[self.dims + k], ax[j])
            out[j] = out[j] + forward(q[self.dims + k], ax[i])
        return out

    def advance(self, s: list[np.ndarray]) -> list[np.ndarray]:
        t, problem = self.step, self.p
        f, ax = s[0], axes_of(s[0])
        lam = s[1] if problem.weights else problem.weight
        u, ubar, p, v, vbar, q, levels = self.split(s)
        deep = problem.order > 1
        new_p = self._project([p[i] + t * (forward(ubar, ax[i]) - (vbar[i] if deep else 0)) for i in range(self.dims)], problem.alpha[0], False)
        moved = u - t * sum(backward(new_p[i], ax[i]) for i in range(self.dims))
        if problem.data == "l2":
            new_u = (moved + t * lam * f) / (1 + t * lam)
        else:
            d = moved - f
            new_u = np.where(d > t * lam, moved - t * lam, np.where(d < -t * lam, moved + t * lam, f))
        out = [new_u, 2 * new_u - u, *new_p]
        if deep:
            over = levels[0][1] if levels else [0] * self.tensor
            e = self._symmetric(vbar, ax, backward)
            new_q = self._project([q[i] + t * (e[i] - over[i]) for i in range(self.tensor)], problem.alpha[1], True)
            back = self._contract(new_q, ax)
            new_v = [v[i] - t * (back[i] - new_p[i]) for i in range(self.dims)]
            out += [*new_v, *(2 * a - b for a, b in zip(new_v, v, strict=True)), *new_q]
            below = new_q
            for i, (w, wbar, r) in enumerate(levels):
                odd = i % 2 == 1 if problem.first_gradient == "backward" else i % 2 == 0
                g, d = (forward, backward) if odd else (backward, forward)
                above = levels[i + 1][1] if i + 1 < len(levels) else [0] * self.tensor
                gw = self._levelwise(wbar, ax, g)
                new_r = self._project([r[k] + t * (gw[k] - above[k]) for k in range(self.tensor)], problem.alpha[i + 2], True)
                dr = self._levelwise(new_r, ax, d)
                new_w = [w[k] - t * (dr[k] - below[k]) for k in range(self.tensor)]
                out += [*new_w, *(2 * a - b for a, b in zip(new_w, w, strict=True)), *new_r]
                below = new_r
        if problem.masked:
            inside = s[self.inputs - 1] >= 1
            out = [np.where(inside, new, old) for new, old in zip(out, s[self.inputs :], strict=True)]
        return [*s[: self.inputs], *out]


def solve(problem: Variation, fields: list[np.ndarray], iterations: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """u and v (the components of the smooth part's gradient; none for order 1) of one image."""
    solver = Solver(problem, len(axes_of(fields[0])))
    s = solver.start(fields)
    for _ in range(iterations):
        s = solver.advance(s)
    u, _, _, v, *_ = solver.split(s)
    return u, v


def _basis(n: int) -> np.ndarray:
    return np.cos(np.pi * np.outer(np.arange(n), np.arange(n) + 0.5) / n)  # (frequency, place)


def poisson(f: np.ndarray) -> np.ndarray:
    """The zero-mean solution of -laplace(u) = f with free borders, by cosine transforms."""
    out, eigen = f, np.zeros(f.shape[-3:])
    for axis in (-3, -2, -1):
        n, shape = f.shape[axis], [1, 1, 1]
        out = np.moveaxis(np.tensordot(_basis(n), out, (1, axis)), 0, axis)
        shape[axis] = n
        eigen = eigen + (2 - 2 * np.cos(np.pi * np.arange(n) / n)).reshape(shape)
    eigen[0, 0, 0] = 1
    out = out / eigen
    out[..., 0, 0, 0] = 0
    for axis in (-3, -2, -1):
        n = f.shape[axis]
        inverse = _basis(n).T * (np.where(np.arange(n) == 0, 1, 2) / n)
        out = np.moveaxis(np.tensordot(inverse, out, (1, axis)), 0, axis)
    return out


def integrate(v: list[np.ndarray]) -> np.ndarray:
    """The image whose gradient is nearest to v, with mean 0."""
    ax = axes_of(v[0])
    return poisson(sum(backward(v[i], ax[i]) for i in range(len(v))))


def spline_coefficients(c: np.ndarray) -> np.ndarray:
    """Coefficients of the cubic B-spline through the values of a line, with mirrored ends."""
    n = len(c)
    if n == 1:
        return c
    z, c = np.sqrt(3) - 2, c * 6
    c[0] = (z ** np.arange(2 * n - 2) * np.concatenate([c, c[-2:0:-1]])).sum() / (1 - z ** (2 * n - 2))
    for i in range(1, n):
        c[i] += z * c[i - 1]
    c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = z * (c[i + 1] - c[i])
    return c
