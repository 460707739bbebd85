"""Singular values and right singular vectors of a small matrix by differential quotients.

``bidiagonal`` reduces a square matrix to upper bidiagonal form by Householder reflections,
``dqds`` finds the singular values of that form by the differential quotient-difference
algorithm with shifts, to high relative accuracy, and ``vectors`` recovers right singular
vectors by twisted factorisations of the tridiagonal ``BᵀB``, which is never formed: its
factors are ``L D Lᵀ`` with the squares of the diagonal in ``D``.

Vectors whose values are close are orthogonalised against each other and iterated anew until
they stand apart, so that also equal values get orthonormal vectors.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(np.float64).eps
TINY = np.finfo(np.float64).tiny
# Sweeps for one value, far above what any needs.
SWEEPS = 200
# Values nearer than this, relative to each other, have their vectors orthogonalised.
CLOSE = 1e-3
ITERATIONS = 5


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and the first entry of ``(I - 2 v vᵀ) x``, whose other entries are zero."""
    largest = np.abs(x).max(initial=0)
    if largest == 0 or not np.abs(x[1:]).any():
        return np.zeros_like(x), float(x[0]) if len(x) else 0.0
    v = x / largest
    norm = np.sqrt(v @ v)
    head = -np.copysign(norm, v[0])
    v = v.copy()
    v[0] -= head
    return v / np.sqrt(v @ v), float(head * largest)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, superdiagonal and the right reflectors of a square matrix's bidiagonal form."""
    a = np.array(matrix, np.float64)
    n = len(a)
    diagonal, above, right = np.zeros(n), np.zeros(max(n - 1, 0)), []
    for k in range(n):
        v, diagonal[k] = _reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < n - 1:
            v, above[k] = _reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            right.append(v)
    return diagonal, above, right


def applied(right: list[np.ndarray], vector: np.ndarray) -> np.ndarray:
    """A right singular vector of the bidiagonal form as one of the matrix it was made from."""
    out = vector.copy()
    for k in reversed(range(len(right))):
        out[k + 1 :] -= 2 * right[k] * (right[k] @ out[k + 1 :])
    return out


def _sweep(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float, bool]:
    """One differential transform with a shift; the least ``d``, and whether all were positive."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(max(n - 1, 0))
    d = least = q[0] - shift
    for k in range(n - 1):
        new_q[k] = d + e[k]
        if d < 0 or new_q[k] <= 0:
            return new_q, new_e, least, False
        ratio = q[k + 1] / new_q[k]
        new_e[k] = e[k] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[n - 1] = d
    return new_q, new_e, least, bool(d >= 0 and np.isfinite(new_q).all() and np.isfinite(new_e).all())


def _two(q: np.ndarray, e: float) -> tuple[float, float]:
    """Both eigenvalues of a 2 by 2 block, larger first."""
    a, b, c = q[0] + e, np.sqrt(q[1] * e), q[1]
    # the matrix [[q0, .], [., e + q1]] of the block has this trace and determinant
    trace, determinant = a + c, q[0] * q[1]
    root = np.hypot(a - c, 2 * b)
    large = (trace + root) / 2
    return large, determinant / large if large > 0 else 0.0


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    largest = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if largest == 0:
        return np.zeros(len(diagonal))
    pending = [((diagonal / largest) ** 2, (above / largest) ** 2, 0.0)]
    found: list[float] = []
    while pending:
        q, e, shifted = pending.pop()
        tries = 0
        while len(q) > 2:
            # An entry above the diagonal is dropped, which splits the matrix, where neither its
            # square nor its product with the diagonal changes a value beyond rounding.
            rounding = 8 * EPS * (q[1:] + shifted)
            small = (e <= rounding) & (q[:-1] * e <= rounding**2) | (e <= TINY)
            if small.any():
                at = int(np.flatnonzero(small)[-1]) + 1
                pending.append((q[:at], e[: at - 1], shifted))
                q, e, tries = q[at:], e[at:], 0
                continue
            if q[0] < q[-1]:
                # values come out from the end fastest when they fall towards it
                q, e = _reversed(q, e)
            shift = 0.0 if tries > SWEEPS // 2 else max(0.0, _least_bound(q, e))
            new_q, new_e, least, fine = _sweep(q, e, shift)
            while not fine and shift > 0:
                shift = shift / 4 if shift > EPS * (shifted + q[-1]) else 0.0
                new_q, new_e, least, fine = _sweep(q, e, shift)
            # without a shift no difference is taken, so that such a sweep cannot fail
            if not fine or tries > SWEEPS:
                raise ArithmeticError("no singular value after many sweeps")
            q, e, shifted, tries = new_q, new_e, shifted + shift, tries + 1
        if len(q) == 2:
            found += [shifted + x for x in _two(q, e[0])]
        elif len(q) == 1:
            found.append(shifted + q[0])
    return np.sort(np.array(found))[::-1] * largest**2


def _reversed(q: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same values in a form whose order is turned round."""
    n = len(q)
    # L D Lᵀ factored from the other end: a zero-shift transform of the flipped tridiagonal
    diagonal = q + np.concatenate([[0.0], e])
    diagonal = diagonal[::-1]
    square = (q[:-1] * e)[::-1]
    new_q, new_e = np.empty(n), np.empty(n - 1)
    new_q[0] = diagonal[0]
    for k in range(n - 1):
        new_e[k] = square[k] / new_q[k] if new_q[k] > 0 else 0.0
        new_q[k + 1] = max(diagonal[k + 1] - new_e[k], 0.0)
    return new_q, new_e


def _least_bound(q: np.ndarray, e: np.ndarray) -> float:
    """A guess, from the last rows, of a shift just below the least value."""
    _, least = _two(q[-2:], e[-1])
    # the row before pulls the least value down by at most its coupling
    coupling = e[-2] * q[-1] / max(q[-2], TINY) if len(e) > 1 else 0.0
    return least - coupling if coupling < least else 0.0


class Twisted:
    """``BᵀB - λ`` factored from both ends, meeting where the remainder is least."""

    def __init__(self, diagonal: np.ndarray, above: np.ndarray, value: float):
        n = len(diagonal)
        q = diagonal**2
        # the tridiagonal's entries: q_k + b_{k-1}² on the diagonal, a_k b_k beside it
        self.side = side = diagonal[:-1] * above
        floor = EPS * EPS * max(q.max(initial=0), TINY) + TINY
        self.down, self.up = down, up = np.empty(n), np.empty(n)
        s, gamma_s = -value, np.empty(n)
        for k in range(n):  # stationary, from the top
            gamma_s[k] = s
            down[k] = q[k] + s
            if abs(down[k]) < floor:
                down[k] = floor
            if k < n - 1:
                s = above[k] ** 2 / down[k] * s - value
        p, gamma_p = q[n - 1] - value, np.empty(n)
        for k in reversed(range(n)):  # progressive, from the bottom
            gamma_p[k] = p
            if k:
                up[k] = above[k - 1] ** 2 + p
                if abs(up[k]) < floor:
                    up[k] = floor
                p = p * (q[k - 1] / up[k]) - value
        up[0] = p
        gamma = gamma_s + gamma_p + value
        self.twist = int(np.argmin(np.abs(gamma)))
        self.gamma = gamma[self.twist]
        self.floor = floor

    def vector(self) -> np.ndarray:
        """Solves ``N D Nᵀ z = γ e_r``: no division by the remainder is needed."""
        r, n = self.twist, len(self.down)
        z = np.zeros(n)
        z[r] = 1.0
        for k in reversed(range(r)):
            z[k] = -self.side[k] / self.down[k] * z[k + 1]
        for k in range(r, n - 1):
            z[k + 1] = -self.side[k] / self.up[k + 1] * z[k]
        return z / np.sqrt(z @ z)

    def solve(self, rhs: np.ndarray) -> np.ndarray:
        r, n = self.twist, len(self.down)
        y = rhs.astype(np.float64).copy()
        for k in range(r):
            y[k + 1] -= self.side[k] / self.down[k] * y[k]
        for k in reversed(range(r + 1, n)):
            y[k - 1] -= self.side[k - 1] / self.up[k] * y[k]
        middle = self.gamma if abs(self.gamma) > self.floor else self.floor
        y[:r] /= self.down[:r]
        y[r] /= middle
        y[r + 1 :] /= self.up[r + 1 :]
        for k in reversed(range(r)):
            y[k] -= self.side[k] / self.down[k] * y[k + 1]
        for k in range(r, n - 1):
            y[k + 1] -= self.side[k] / self.up[k + 1] * y[k]
        return y


def _apart(vector: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for other in others:
            vector = vector - (other @ vector) * other
    return vector


def vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Orthonormal right singular vectors, as rows, of the squared ``values``, which fall."""
    n = len(diagonal)
    found: list[np.ndarray] = []
    noise = np.random.default_rng(0)
    for k, value in enumerate(values):
        near = [v for v, other in zip(found, values) if abs(other - value) <= CLOSE * abs(other)]
        factors = Twisted(diagonal, above, value)
        candidate = factors.vector()
        vector = _apart(candidate, near)
        for _ in range(ITERATIONS):
            size = np.sqrt(vector @ vector)
            if np.isfinite(size) and size > 0.5 and (not near or _settled(diagonal, above, value, vector / size)):
                break
            if not np.isfinite(size) or size < 1e-8:
                vector, size = _apart(noise.standard_normal(n), near), 1.0
            step = factors.solve(vector / max(size, TINY))
            step = step / np.abs(step).max()
            vector = _apart(step / np.sqrt(step @ step), near)
        found.append(vector / np.sqrt(vector @ vector))
    return np.array(found).reshape(len(found), n)


def _settled(diagonal: np.ndarray, above: np.ndarray, value: float, vector: np.ndarray) -> bool:
    """Is the vector one of ``BᵀB`` for this value, up to rounding?"""
    b = diagonal * vector
    b[:-1] += above * vector[1:]
    back = diagonal * b
    back[1:] += above * b[:-1]
    largest = float(np.max(diagonal**2, initial=0) + np.max(above**2, initial=0))
    return bool(np.abs(back - value * vector).max() <= 64 * EPS * len(vector) * largest)
