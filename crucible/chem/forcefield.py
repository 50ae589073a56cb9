"""A molecular force field: seven terms in their customary forms, with parameters by rule, and two minimisers.

The forms are those of MMFF94 (Halgren): quartic bonds, cubic angles, stretch-bend, out-of-plane, threefold torsions, buffered
14-7 van der Waals and buffered electrostatics. The parameters are not its tables: lengths come from covalent radii, angles
from hybridisation, constants are one value a kind. So energies rank geometries of one molecule; they aren't MMFF94's.
Energies are in kcal/mol, lengths in Å.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

from crucible.chem.elements import bond_length, element
from crucible.chem.geometry import embed, gasteiger
from crucible.chem.graph import Molecule

# Conversion factors of the terms, and the constants of the rules.
BOND, ANGLE, LINEAR, STRETCH_BEND, COULOMB, COULOMB_14 = 71.96625, 0.021922, 143.9325, 2.51210, 332.0716, 249.0537
KB = {1: 4.5, 2: 9.0, 3: 15.0}
KA, KSB, KOOP = 0.8, 0.15, 0.05
TORSION = {"sp3": (0.0, 0.0, 0.3), "sp2": (0.0, 6.0, 0.0), "single": (0.0, 0.6, 0.1)}


def _angle(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    c = (u * v).sum(-1) / np.maximum(np.linalg.norm(u, axis=-1) * np.linalg.norm(v, axis=-1), 1e-12)
    return np.arccos(np.clip(c, -1, 1))


def bond_energy(r: np.ndarray, r0: np.ndarray, k: np.ndarray) -> np.ndarray:
    d = r - r0
    return BOND * k * d * d * (1 - 2 * d + 7 / 3 * d * d)


def angle_energy(t: np.ndarray, t0: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Angles in degrees; an ideal angle of 180 takes the form for linear centres."""
    d = t - t0
    return np.where(t0 >= 179.9, LINEAR * k * (1 + np.cos(np.radians(t))), ANGLE * k * d * d * (1 - 0.007 * d))


def stretch_bend_energy(d1: np.ndarray, d2: np.ndarray, dt: np.ndarray, k: np.ndarray) -> np.ndarray:
    return STRETCH_BEND * k * (d1 + d2) * dt


def out_of_plane_energy(chi: np.ndarray, k: np.ndarray) -> np.ndarray:
    return ANGLE * k * chi * chi


def torsion_energy(phi: np.ndarray, v: np.ndarray) -> np.ndarray:
    return 0.5 * (v[..., 0] * (1 + np.cos(phi)) + v[..., 1] * (1 - np.cos(2 * phi)) + v[..., 2] * (1 + np.cos(3 * phi)))


def van_der_waals_energy(r: np.ndarray, r0: np.ndarray, e: np.ndarray) -> np.ndarray:
    x = r / r0
    return e * (1.07 / (x + 0.07)) ** 7 * (1.12 / (x**7 + 0.12) - 2)


def electrostatic_energy(r: np.ndarray, q: np.ndarray, near: np.ndarray) -> np.ndarray:
    """q are products of charges; near tells pairs three bonds apart."""
    return np.where(near, COULOMB_14, COULOMB) * q / (r + 0.05)


class ForceField:
    """The interactions of a molecule's atoms; hydrogens that are no atoms of their own have none."""

    def __init__(self, m: Molecule):
        n, order = m.n, [2 if m.arom_bond[k] else o for k, o in enumerate(m.order)]
        size = {}
        for k, (a, b) in enumerate(m.ends):
            size[a, b] = size[b, a] = bond_length(m.symbol[a], m.symbol[b], 1.5 if m.arom_bond[k] else m.order[k]) or 1.5
        self.bonds = np.array(m.ends, int).reshape(-1, 2)
        self.r0, self.kb = np.array([size[e] for e in m.ends]), np.array([KB.get(o, 4.5) for o in order])
        self.angles = np.array([(x, i, y) for i in range(n) for x, y in combinations(sorted(j for j, _ in m.near[i]), 2)], int).reshape(-1, 3)
        self.t0 = np.array([{"sp": 180.0, "sp2": 120.0}.get(m.hyb[i], 109.5) for _, i, _ in self.angles])
        self.ra, self.rb = (np.array([size[i, (x, y)[side]] for x, i, y in self.angles]) for side in (0, 1))
        self.planes = np.array([(i, *sorted(j for j, _ in m.near[i])) for i in range(n) if m.hyb[i] == "sp2" and len(m.near[i]) == 3], int).reshape(-1, 4)
        self.torsions, v = [], []
        for k, (b, c) in enumerate(m.ends):
            kind = "sp2" if order[k] == 2 else "single" if "sp2" in (m.hyb[b], m.hyb[c]) else "sp3"
            for a, _ in m.near[b]:
                for d, _ in m.near[c]:
                    if a != c and d != b and a != d and "sp" not in (m.hyb[b], m.hyb[c]):
                        self.torsions.append((a, b, c, d))
                        v.append(TORSION[kind])
        self.torsions, self.v = np.array(self.torsions, int).reshape(-1, 4), np.array(v).reshape(-1, 3)
        apart = exclusions(m)
        pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if apart.get((i, j), 4) > 2]
        self.pairs = np.array(pairs, int).reshape(-1, 2)
        self.near = np.array([apart.get(p, 4) == 3 for p in pairs], bool)
        radius = np.array([(element(s) or element("C")).vdw_radius for s in m.symbol])
        i, j = self.pairs.T
        self.rv, self.ev = radius[i] + radius[j], np.where(self.near, 0.03, 0.06)
        q = np.array(gasteiger(m))
        self.qq = q[i] * q[j] if len(self.pairs) else np.zeros(0)

    def terms(self, x: np.ndarray) -> dict[str, float]:
        """Energy by term."""
        d = lambda a, b: np.linalg.norm(x[b] - x[a], axis=-1)
        a, i, b = self.angles.T
        t = np.degrees(_angle(x[a] - x[i], x[b] - x[i]))
        p = self.planes.T
        u, v, w = (x[p[k]] - x[p[0]] for k in (1, 2, 3))
        normal = np.cross(u, v)
        chi = np.degrees(np.arcsin(np.clip((normal * w).sum(-1) / np.maximum(np.linalg.norm(normal, axis=-1) * np.linalg.norm(w, axis=-1), 1e-12), -1, 1)))
        e, f, g, h = self.torsions.T
        b1, b2, b3 = x[f] - x[e], x[g] - x[f], x[h] - x[g]
        n1, n2 = np.cross(b1, b2), np.cross(b2, b3)
        phi = np.arctan2((np.cross(n1, n2) * b2).sum(-1) / np.maximum(np.linalg.norm(b2, axis=-1), 1e-12), (n1 * n2).sum(-1))
        r = d(*self.pairs.T)
        return {
            "bond": float(bond_energy(d(*self.bonds.T), self.r0, self.kb).sum()), "angle": float(angle_energy(t, self.t0, np.full(len(t), KA)).sum()),
            "stretch_bend": float(stretch_bend_energy(d(i, a) - self.ra, d(i, b) - self.rb, np.where(self.t0 < 179.9, t - self.t0, 0.0), np.full(len(t), KSB)).sum()), "out_of_plane": float(out_of_plane_energy(chi, np.full(len(chi), KOOP)).sum()),
            "torsion": float(torsion_energy(phi, self.v).sum()), "van_der_waals": float(van_der_waals_energy(r, self.rv, self.ev).sum()), "electrostatic": float(electrostatic_energy(r, self.qq, self.near).sum()),
        }

    def energy(self, x: np.ndarray) -> float:
        return sum(self.terms(x).values())

    def gradient(self, x: np.ndarray, step: float = 1e-5) -> np.ndarray:
        """Central differences."""
        g = np.zeros_like(x)
        for k in np.ndindex(*x.shape):
            y = x.copy()
            y[k] += step
            up = self.energy(y)
            y[k] -= 2 * step
            g[k] = (up - self.energy(y)) / (2 * step)
        return g


def exclusions(m: Molecule) -> dict[tuple[int, int], int]:
    """Bonds apart, one to three, of the pairs of atoms (smaller first) that are."""
    out: dict[tuple[int, int], int] = {}
    for s in range(m.n):
        seen, edge = {s}, [s]
        for d in (1, 2, 3):
            edge = [y for x in edge for y, _ in m.near[x] if y not in seen and not seen.add(y)]
            for y in edge:
                if s < y:
                    out[s, y] = d
    return out


def steepest_descent(f: ForceField, x: np.ndarray, rounds: int = 100, enough: float = 1e-4) -> tuple[np.ndarray, float, bool]:
    """Coordinates, energy, and whether the largest slope fell below `enough`; the step grows when it helps and halves when not."""
    e, step = f.energy(x), 0.01
    for _ in range(rounds):
        g = f.gradient(x)
        if np.abs(g).max(initial=0.0) < enough:
            return x, e, True
        y = x - step * g / max(1.0, float(np.linalg.norm(g)))
        new = f.energy(y)
        if new < e:
            x, e, step = y, new, step * 1.2
        else:
            step /= 2
    return x, e, False


def lbfgs(f: ForceField, x: np.ndarray, rounds: int = 60, enough: float = 1e-3, memory: int = 10) -> tuple[np.ndarray, float, bool]:
    """As `steepest_descent`, by limited-memory BFGS with backtracking."""
    e, g, past = f.energy(x), f.gradient(x), []
    for _ in range(rounds):
        if np.abs(g).max(initial=0.0) < enough:
            return x, e, True
        q, used = g.ravel().copy(), []
        for s, y in reversed(past):
            a = float(s @ q) / float(s @ y)
            q -= a * y
            used.append(a)
        if past:
            s, y = past[-1]
            q *= float(s @ y) / float(y @ y)
        for (s, y), a in zip(past, reversed(used), strict=True):
            q += (a - float(y @ q) / float(s @ y)) * s
        way = -q.reshape(x.shape)
        if float((way * g).sum()) >= 0:
            way, past = -g, []
        t = min(1.0, 0.3 / max(1e-12, float(np.abs(way).max())))
        while t > 1e-10:
            new = f.energy(x + t * way)
            if new <= e + 1e-4 * t * float((way * g).sum()):
                break
            t /= 2
        else:
            return x, e, False
        h = f.gradient(x + t * way)
        s, y = (t * way).ravel(), (h - g).ravel()
        if float(s @ y) > 1e-12:
            past = [*past, (s, y)][-memory:]
        x, e, g = x + t * way, new, h
    return x, e, False


def optimised(m: Molecule, rounds: int = 60) -> tuple[np.ndarray, dict[str, float], bool]:
    """Minimised coordinates of the embedded atoms, their energy by term, and whether the minimum was reached."""
    f = ForceField(m)
    x, _, done = lbfgs(f, embed(m), rounds)
    return x, f.terms(x), done
