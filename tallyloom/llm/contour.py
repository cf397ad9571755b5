"""Leading eigenpairs of a symmetric matrix by contour integration.

The matrix is as wide as a vector is long, so this is small work for one machine. Inertia counts (a
symmetric factorisation of the shifted matrix has as many negative pivots as there are eigenvalues
below the shift) place intervals with a few eigenvalues each. In each, quadrature of complex shifted
solves along a circle projects a block of vectors onto the interval's eigenspace, Rayleigh-Ritz takes
the pairs out, and both are repeated until the residuals settle. A last Rayleigh-Ritz over all of them
makes them orthonormal, and the counts prove that none is missed.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)


def below(a: np.ndarray, shift: float) -> int:
    """How many eigenvalues of the symmetric ``a`` are below ``shift``: negative pivots of a factorisation
    with whole pivoting by one or two rows at a time."""
    a = a - shift * np.eye(len(a))
    negative, alpha = 0, (1 + 17**0.5) / 8
    while len(a):
        diagonal = np.abs(np.diagonal(a))
        r = int(np.argmax(diagonal))
        off = np.abs(np.triu(a, 1))
        p, q = divmod(int(np.argmax(off)), len(a))
        if diagonal[r] == 0 and off[p, q] == 0:
            break  # what is left is zero
        if diagonal[r] >= alpha * off[p, q]:
            rest = np.delete(np.arange(len(a)), r)
            negative += a[r, r] < 0
            a = a[np.ix_(rest, rest)] - np.outer(a[rest, r], a[rest, r] / a[r, r])
        else:
            rest = np.delete(np.arange(len(a)), [p, q])
            pair = a[np.ix_([p, q], [p, q])]
            negative += int((np.linalg.eigvalsh(pair) < 0).sum())
            side = a[np.ix_(rest, [p, q])]
            a = a[np.ix_(rest, rest)] - side @ np.linalg.solve(pair, side.T)
    return int(negative)


def _intervals(a: np.ndarray, wanted: int, low: float, high: float, most: int) -> list[tuple[float, float, int]]:
    """``(low, high, count)`` of adjoining intervals from the top with ``wanted`` eigenvalues or more, each with
    ``most`` at most unless they can't be told apart."""
    out, found, width = [], 0, high - low
    todo = [(low, high, 0, len(a))]
    while todo and found < wanted:
        lo, hi, under_lo, under_hi = todo.pop()
        inside = under_hi - under_lo
        if not inside:
            continue
        if inside <= most or hi - lo <= 1e-8 * width:
            out.append((lo, hi, inside))
            found += inside
            continue
        mid = (lo + hi) / 2
        under = below(a, mid)
        todo += [(lo, mid, under_lo, under), (mid, hi, under, under_hi)]
    return out


def _ritz(a: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    basis, _ = np.linalg.qr(block)
    values, vectors = np.linalg.eigh(basis.T @ a @ basis)
    return values, basis @ vectors


def _project(a: np.ndarray, block: np.ndarray, low: float, high: float, nodes: int) -> np.ndarray:
    """The block's part in the eigenspace of an interval, by Gauss-Legendre quadrature of the resolvent
    along the upper half of the circle over it (the lower half is its mirror image)."""
    centre, radius = (low + high) / 2, (high - low) / 2
    at, weight = np.polynomial.legendre.leggauss(nodes)
    out = np.zeros_like(block)
    for x, w in zip(at, weight, strict=True):
        turn = np.exp(0.5j * np.pi * (1 - x))
        out += 0.5 * w * (radius * turn * np.linalg.solve((centre + radius * turn) * np.eye(len(a)) - a, block.astype(complex))).real
    return out


def leading(a: np.ndarray, wanted: int, most: int = 12, nodes: int = 12, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    size = len(a)
    wanted = min(wanted, size)
    reach = float(np.abs(a).sum(1).max()) if size else 0.0
    if not wanted or reach == 0:
        return np.zeros(wanted), np.eye(size)[:, :wanted]
    # Every eigenvalue is within the row sums; the ends are moved off them.
    low, high = -1.01 * reach, 1.01 * reach
    norm = float(np.linalg.norm(a, 2)) if size <= 64 else reach
    rng = np.random.default_rng(12)
    vectors = []
    for lo, hi, inside in _intervals(a, wanted, low, high, most):
        # Eigenvalues just outside fade slowly: the block holds those of a wider interval as well.
        near = below(a, hi + (hi - lo) / 2) - below(a, lo - (hi - lo) / 2)
        block = rng.standard_normal((size, min(size, max(inside, near) + inside // 2 + 6)))
        # A pad keeps eigenvalues at the very ends within the circle; what it adds is left out below.
        pad = max((hi - lo) * 0.02, 64 * EPS * norm)
        best, kept = np.inf, None
        for _ in range(rounds):
            values, block = _ritz(a, _project(a, block, lo - pad, hi + pad, nodes))
            # The pairs of the interval are the ones nearest to its middle that settle.
            chosen = np.sort(np.argsort(np.maximum(lo - values, values - hi), kind="stable")[:inside])
            left = np.linalg.norm(a @ block[:, chosen] - block[:, chosen] * values[chosen], axis=0).max()
            if left < best:
                best, kept = left, block[:, chosen]
            if left <= 8 * EPS * norm or (left >= 0.5 * best and best <= 1e3 * EPS * norm):
                break
        if kept is None or best > 1e5 * EPS * norm:
            raise ArithmeticError(f"contour integration left a residual of {best / norm:.1e}")
        vectors.append(kept)
    values, block = _ritz(a, np.concatenate(vectors, 1))
    values, block = values[::-1][:wanted], block[:, ::-1][:, :wanted]
    # None missed: as many eigenvalues stand above a shift just under the last one as were found.
    shift = values[-1] - max(1e-9 * norm, 64 * EPS * norm * size)
    above = size - below(a, shift)
    if above < wanted or size - below(a, values[-1] + (values[-1] - shift)) > wanted:
        raise ArithmeticError("inertia counts tell another number of eigenvalues")
    return values, block
