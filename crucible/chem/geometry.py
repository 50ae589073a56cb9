"""Kernels on coordinates: surfaces, shape, superposition, charges, sequence alignment."""

from __future__ import annotations

import numpy as np

from crucible.chem.elements import EN, MASS, element
from crucible.chem.graph import Molecule


def fibonacci_sphere(n: int) -> np.ndarray:
    """n nearly even points on the unit sphere."""
    i = np.arange(n) + 0.5
    z = 1 - 2 * i / n
    a = np.pi * (1 + 5**0.5) * i
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(a), r * np.sin(a), z], axis=1)


def surface(xyz: np.ndarray, symbols: list[str], probe: float = 1.4, points: int = 256) -> np.ndarray:
    """Solvent-accessible area of each atom (Shrake and Rupley): the share of sphere points inside no other atom's sphere."""
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    r = np.array([(element(s) or element("C")).vdw_radius for s in symbols]) + probe
    unit, out = fibonacci_sphere(points), np.zeros(len(xyz))
    for i in range(len(xyz)):
        d2 = ((xyz - xyz[i]) ** 2).sum(axis=1)
        near = np.flatnonzero((d2 < (r + r[i]) ** 2) & (np.arange(len(xyz)) != i))
        p = xyz[i] + r[i] * unit
        free = np.ones(points, bool)
        for at in range(0, len(near), 64):
            own = near[at : at + 64]
            c = xyz[own]
            apart = (p * p).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * p @ c.T
            free &= (apart > r[own][None, :] ** 2).all(axis=1)
        out[i] = 4 * np.pi * r[i] ** 2 * free.mean()
    return out


def volume(xyz: np.ndarray, symbols: list[str], samples: int = 10_000, seed: int = 0) -> float:
    """Van der Waals volume by seeded sampling of the bounding box."""
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    if not len(xyz):
        return 0.0
    r = np.array([(element(s) or element("C")).vdw_radius for s in symbols])
    lo, hi = (xyz - r[:, None]).min(axis=0), (xyz + r[:, None]).max(axis=0)
    p, inside = lo + np.random.default_rng(seed).random((samples, 3)) * (hi - lo), np.zeros(samples, bool)
    for at in range(0, len(xyz), 64):
        c, q = xyz[at : at + 64], r[at : at + 64]
        inside |= ((p * p).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2 * p @ c.T <= (q * q)[None, :]).any(axis=1)
    return float(inside.mean() * np.prod(hi - lo))


def shape(xyz: np.ndarray, symbols: list[str]) -> dict[str, float]:
    """Gyration, inertia and extent descriptors. The principal moments are those of the gyration tensor."""
    x = np.asarray(xyz, float).reshape(-1, 3)
    if not len(x):
        return {}
    c = x - x.mean(axis=0)
    g = np.sort(np.linalg.eigvalsh(c.T @ c / len(x)))[::-1]
    m = np.array([MASS.get(s, 0.0) for s in symbols])
    w = x - (m[:, None] * x).sum(axis=0) / max(m.sum(), 1e-12)
    inertia = (m[:, None, None] * ((w * w).sum(axis=1)[:, None, None] * np.eye(3) - w[:, :, None] * w[:, None, :])).sum(axis=0)
    i = np.sort(np.linalg.eigvalsh(inertia))
    axes = np.linalg.svd(c, full_matrices=False)[2]
    span = np.sort(np.ptp(c @ axes.T, axis=0))[::-1]
    span = np.concatenate([span, np.zeros(3 - len(span))])
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(axis=2), 0))[np.triu_indices(len(x), 1)]
    mm = np.outer(m, m)[np.triu_indices(len(x), 1)]
    div = lambda a, b: float(a / b) if b else 0.0
    return {
        "RadiusOfGyration": float(np.sqrt((c * c).sum(axis=1).mean())), "MassWeightedRadiusOfGyration": float(np.sqrt(div((m * (w * w).sum(axis=1)).sum(), m.sum()))), "Asphericity": 1 - 3 * div(g[0] * g[1] + g[1] * g[2] + g[0] * g[2], g.sum() ** 2),
        "Eccentricity": div(np.sqrt(max(g[0] ** 2 - g[2] ** 2, 0)), g[0]), "PrincipalMoment1": float(g[0]), "PrincipalMoment2": float(g[1]), "PrincipalMoment3": float(g[2]), "InertiaMomentA": float(i[0]), "InertiaMomentB": float(i[1]), "InertiaMomentC": float(i[2]),
        "NPR1": div(i[0], i[2]), "NPR2": div(i[1], i[2]), "InertialShapeFactor": div(i[1], i[0] * i[2]), "SpherocityIndex": 3 * div(g[2], g.sum()), "MolecularLength": float(span[0]), "MolecularWidth": float(span[1]), "MolecularThickness": float(span[2]),
        "LengthToWidthRatio": div(span[0], span[1]), "BoundingBoxVolume": float(np.prod(span)), "Span": float(np.sqrt((c * c).sum(axis=1)).max()), "MolecularDiameter": float(d.max()) if len(d) else 0.0, "MeanAtomicDistance3D": float(d.mean()) if len(d) else 0.0,
        "GeometricWienerIndex": float(d.sum()), "GravitationalIndex": float((mm[d > 0] / d[d > 0] ** 2).sum()), "PlaneOfBestFit": float(np.abs(c @ axes[-1]).mean()) if len(axes) == 3 else 0.0,
    }


def kabsch(a: np.ndarray, b: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Rotation R and shift t that bring a onto b (R a + t), and the weighted RMSD; never a reflection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    w = np.ones(len(a)) if weights is None else np.asarray(weights, float)
    w = w / w.sum()
    ca, cb = w @ a, w @ b
    u, _, v = np.linalg.svd((w[:, None] * (a - ca)).T @ (b - cb))
    r = v.T @ np.diag([1, 1, np.sign(np.linalg.det(v.T @ u.T)) or 1]) @ u.T
    t = cb - r @ ca
    return r, t, float(np.sqrt(w @ ((a @ r.T + t - b) ** 2).sum(axis=1)))


def superpose(a: np.ndarray, b: np.ndarray, cycles: int = 5, cutoff: float = 2.0) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Kabsch, repeated without the pairs further apart than cutoff times the RMSD; at least three pairs stay."""
    keep = np.arange(len(a))
    r, t, e = kabsch(a, b)
    for _ in range(cycles):
        d = np.sqrt((((a @ r.T + t) - b) ** 2).sum(axis=1))
        new = keep[d[keep] <= cutoff * e] if e > 1e-12 else keep
        if len(new) < 3 or len(new) == len(keep):
            break
        keep = new
        r, t, e = kabsch(a[keep], b[keep])
    return r, t, e, len(keep)


# A, b and c of an orbital's electronegativity a + b q + c q^2, by element and hybridisation ('' for any other).
ORBITALS = {
    "H": {"": (7.17, 6.24, -0.56)},
    "C": {"sp3": (7.98, 9.18, 1.88), "sp2": (8.79, 9.32, 1.51), "sp": (10.39, 9.45, 0.73), "": (7.98, 9.18, 1.88)},
    "N": {"sp3": (11.54, 10.82, 1.36), "sp2": (12.87, 11.15, 0.85), "sp": (15.68, 11.70, -0.27), "": (11.54, 10.82, 1.36)},
    "O": {"sp3": (14.18, 12.92, 1.39), "sp2": (17.07, 13.79, 0.47), "": (14.18, 12.92, 1.39)},
    "F": {"": (14.66, 13.85, 2.31)},
    "Cl": {"": (11.00, 9.69, 1.35)},
    "Br": {"": (10.08, 8.47, 1.16)},
    "I": {"": (9.90, 7.96, 0.96)},
    "S": {"sp3": (10.14, 9.13, 1.38), "sp2": (10.88, 9.49, 1.33), "": (10.14, 9.13, 1.38)},
    "P": {"sp3": (8.90, 8.24, 0.96), "": (8.90, 8.24, 0.96)},
    "B": {"sp2": (6.88, 7.28, 1.71), "sp3": (6.10, 6.82, 1.56), "": (6.88, 7.28, 1.71)},
    "Si": {"": (7.30, 6.56, 0.70)},
    "Se": {"": (10.08, 8.47, 1.16)},
    "Na": {"": (2.84, 3.80, -0.34)},
    "K": {"": (2.42, 3.26, -0.47)},
    "Ca": {"": (3.30, 4.36, -0.17)},
    "Mg": {"": (3.75, 4.72, -0.12)},
    "Fe": {"": (6.00, 6.00, 0.50)},
    "Zn": {"": (5.80, 5.90, 0.50)},
}


def _orbital(symbol: str, hyb: str) -> tuple[float, float, float]:
    table = ORBITALS.get(symbol)
    if table is None:
        en = EN.get(symbol, 0.0)
        return (2.5 * en, 2.0 * en, 0.5) if en > 0 else (5.0, 5.0, 0.5)
    return table.get(hyb, table[""])


def gasteiger(m: Molecule, rounds: int = 6) -> list[float]:
    """Partial charges by equalisation of orbital electronegativity along bonds (Gasteiger and Marsili), rounded to four places.

    Charges start as the formal ones. In the k-th round the less electronegative end of every bond gives the other the
    difference over its own electronegativity as a cation, times 2^-k and at most 0.1. What the sum is off is shared evenly.
    Hydrogens that are no atoms of their own don't take part.
    """
    if not m.n:
        return []
    a, b, c = np.array([_orbital(m.symbol[i], m.hyb[i]) for i in range(m.n)]).T
    q, cation = np.array(m.charge, float), a + b + c
    ends = np.array(m.ends, int).reshape(-1, 2)
    for k in range(1, rounds + 1):
        chi = a + b * q + c * q * q
        left = chi[ends[:, 0]] > chi[ends[:, 1]]
        takes, gives = np.where(left, ends[:, 0], ends[:, 1]), np.where(left, ends[:, 1], ends[:, 0])
        gap = np.abs(chi[takes] - chi[gives])
        moved = np.where((gap >= 1e-10) & (cation[gives] > 0), np.minimum(0.5**k * gap / np.where(cation[gives] > 0, cation[gives], 1), 0.1), 0.0)
        np.add.at(q, gives, moved)
        np.add.at(q, takes, -moved)
    off = sum(m.charge) - q.sum()
    if abs(off) > 1e-6:
        q = q + off / m.n
    return [round(float(v), 4) for v in q]


def embed(m: Molecule, steps: int = 80) -> np.ndarray:
    """Coordinates of the atoms, the same for a text at every call; another order of the atoms may give other ones.

    The start is the three main axes of the squared path lengths (an atom's neighbours stand 1.4 Å apart, farther ones nearer
    than their path is long, fragments 4 Å further); then pairs are moved towards bond lengths (sum of covalent radii, shorter
    for higher orders) and the distances of ideal angles, and pushed apart below 3 Å. Axes point so that the first atom off
    zero is positive.
    """
    from crucible.chem.elements import bond_length

    n = m.n
    if n == 0:
        return np.zeros((0, 3))
    d = np.full((n, n), np.inf)
    for s in range(n):
        d[s, s], todo = 0, [s]
        for x in todo:
            for y, _ in m.near[x]:
                if d[s, y] == np.inf:
                    d[s, y] = d[s, x] + 1
                    todo.append(y)
    far = d[np.isfinite(d)].max()
    d = np.where(np.isfinite(d), d, far + 3)
    want = 1.4 * d**0.85
    centre = np.eye(n) - 1 / n
    w, v = np.linalg.eigh(-0.5 * centre @ (want * want) @ centre)
    x = v[:, ::-1][:, :3] * np.sqrt(np.maximum(w[::-1][:3], 0))
    if x.shape[1] < 3:
        x = np.hstack([x, np.zeros((n, 3 - x.shape[1]))])
    for k in range(3):
        off = np.flatnonzero(np.abs(x[:, k]) > 1e-9)
        if len(off) and x[off[0], k] < 0:
            x[:, k] *= -1
    x = x + 1e-3 * np.stack([np.sin(np.arange(n) * t) for t in (1.0, 2.3, 3.7)], axis=1)  # off planes and lines, the same way each time
    pairs, length = [], []
    for k, (a, b) in enumerate(m.ends):
        pairs.append((a, b))
        length.append(bond_length(m.symbol[a], m.symbol[b], 1.5 if m.arom_bond[k] else m.order[k]) or 1.5)
    size = dict(zip([frozenset(p) for p in pairs], length, strict=True))
    for i in range(n):
        angle = np.radians({"sp": 180.0, "sp2": 120.0}.get(m.hyb[i], 109.5))
        ns = sorted(j for j, _ in m.near[i])
        for p in range(len(ns)):
            for r in range(p + 1, len(ns)):
                if frozenset((ns[p], ns[r])) not in size:
                    u, t = size[frozenset((i, ns[p]))], size[frozenset((i, ns[r]))]
                    pairs.append((ns[p], ns[r]))
                    length.append(float(np.sqrt(u * u + t * t - 2 * u * t * np.cos(angle))))
    e, length = np.array(pairs, int).reshape(-1, 2), np.array(length)
    i, j = np.triu_indices(n, 1)
    loose = d[i, j] > 2
    i, j = i[loose], j[loose]
    ends, loose_to = np.concatenate((e, np.stack([i, j], axis=1))), np.full(len(i), 3.0)
    to, push = np.concatenate((length, loose_to)), np.arange(len(e) + len(i)) >= len(e)
    both = np.concatenate((ends[:, 0], ends[:, 1]))
    for _ in range(steps if len(ends) else 0):
        g = x[ends[:, 1]] - x[ends[:, 0]]
        r = np.maximum(np.sqrt((g * g).sum(axis=1)), 1e-9)
        off = np.where(push & (r >= to), 0.0, r - to)
        s = (0.5 * off / r)[:, None] * g
        count = 1 + np.bincount(both, np.tile(off != 0, 2), n)
        move = np.stack([np.bincount(ends[:, 0], s[:, k], n) - np.bincount(ends[:, 1], s[:, k], n) for k in range(3)], axis=1)
        x = x + move / count[:, None] * 1.5
    return x - x.mean(axis=0)


def conformers(m: Molecule, n: int = 10, seed: int = 0) -> list[tuple[float, np.ndarray]]:
    """(strain, coordinates) of n embeddings from starts shaken by the seed, of least strain first; strain is the squared misfit of bond lengths and of pairs nearer than 3 Å."""
    from crucible.chem.elements import bond_length

    base, out = embed(m), []
    want = np.array([bond_length(m.symbol[a], m.symbol[b], 1.5 if m.arom_bond[k] else m.order[k]) or 1.5 for k, (a, b) in enumerate(m.ends)])
    near = {frozenset(e) for e in m.ends} | {frozenset((x, y)) for i in range(m.n) for x, _ in m.near[i] for y, _ in m.near[i] if x < y}
    apart = [(i, j) for i in range(m.n) for j in range(i + 1, m.n) if frozenset((i, j)) not in near]
    for k in range(n):
        x = base + (np.random.default_rng(seed + k).normal(scale=0.3, size=base.shape) if k else 0)
        for _ in range(60):
            for (a, b), to in zip(m.ends, want, strict=True):
                g = x[b] - x[a]
                r = max(float(np.linalg.norm(g)), 1e-9)
                s = 0.4 * (r - to) / r * g
                x[a] += s
                x[b] -= s
        e = sum((float(np.linalg.norm(x[b] - x[a])) - to) ** 2 for (a, b), to in zip(m.ends, want, strict=True))
        e += sum(max(0.0, 3.0 - float(np.linalg.norm(x[i] - x[j]))) ** 2 for i, j in apart)
        out.append((float(e), x))
    return sorted(out, key=lambda t: t[0])


def global_align(a: str, b: str, match: float = 1.0, mismatch: float = -1.0, opening: float = -10.0, extend: float = -0.5) -> tuple[float, list[tuple[int, int]]]:
    """Needleman-Wunsch with affine gaps: score and aligned index pairs."""
    n, k = len(a), len(b)
    low = -1e18
    s = np.full((3, n + 1, k + 1), low)  # pair, gap in b, gap in a
    back = np.zeros((3, n + 1, k + 1), np.int8)
    s[0, 0, 0] = 0
    for i in range(n + 1):
        for j in range(k + 1):
            if i and j:
                prior = s[:, i - 1, j - 1]
                w = int(np.argmax(prior))
                s[0, i, j], back[0, i, j] = prior[w] + (match if a[i - 1] == b[j - 1] else mismatch), w
            if i:
                prior = (s[0, i - 1, j] + opening, s[1, i - 1, j] + extend, s[2, i - 1, j] + opening)
                back[1, i, j] = w = int(np.argmax(prior))
                s[1, i, j] = prior[w]
            if j:
                prior = (s[0, i, j - 1] + opening, s[1, i, j - 1] + opening, s[2, i, j - 1] + extend)
                back[2, i, j] = w = int(np.argmax(prior))
                s[2, i, j] = prior[w]
    w, i, j, pairs = int(np.argmax(s[:, n, k])), n, k, []
    score = float(s[w, n, k])
    while i or j:
        now, w = w, int(back[w, i, j])
        if now == 0:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        elif now == 1:
            i -= 1
        else:
            j -= 1
    return score, pairs[::-1]
