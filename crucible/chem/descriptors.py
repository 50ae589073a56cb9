"""Descriptors of a molecule by name, grouped in families that share a kernel.

`compute(molecule, names)` runs only the families that the names need. Conventions: degrees, distances and spectra are those
of the heavy-atom graph; pairs in different fragments have no distance and don't count; a ratio with an empty denominator is
0. Names that say one thing and compute another keep the customary value under the customary name (noted where it differs).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from itertools import combinations
from math import exp, log2, log10, prod, sqrt

import numpy as np

from crucible.chem.elements import EN, HALOGENS, MASS, Z_OF
from crucible.chem.graph import Molecule

FAMILIES: dict[str, tuple[Callable[[Context], dict[str, float]], tuple[str, ...]]] = {}

# Fixed values, relative or absolute, by element.
_VALENCE_ELECTRONS = {"H": 1, "B": 3, "C": 4, "N": 5, "O": 6, "F": 7, "Si": 4, "P": 5, "S": 6, "Cl": 7, "Se": 6, "Br": 7, "I": 7}
_VDW_VOLUME = {"H": 7.24, "C": 20.58, "N": 15.60, "O": 14.71, "F": 13.31, "P": 24.43, "S": 24.43, "Cl": 22.45, "Br": 26.52, "I": 32.52}
_POLARIZABILITY = {"H": 0.667, "C": 1.76, "N": 1.10, "O": 0.802, "F": 0.557, "P": 3.63, "S": 2.90, "Cl": 2.18, "Br": 3.05, "I": 5.35}
_MCGOWAN = {"H": 8.71, "C": 16.35, "N": 14.39, "O": 12.43, "F": 10.48, "Si": 26.83, "P": 24.87, "S": 22.91, "Cl": 20.95, "Br": 26.21, "I": 34.53, "B": 18.32, "Se": 27.44}


def ratio(a: float, b: float) -> float:
    return a / b if b else 0.0


def entropy(values) -> float:
    """In bits, of the counts of equal values."""
    n = Counter(values)
    total = sum(n.values())
    return -sum(c / total * log2(c / total) for c in n.values()) if total else 0.0


class Context:
    """A molecule with the kernels that several families use, each worked out once."""

    def __init__(self, m: Molecule):
        self.m = m
        self.heavy = m.heavy()
        self.count = Counter(m.symbol)
        self.h = sum(m.hydrogens) + self.count["H"]
        self._kept: dict[str, object] = {}

    def once(self, name: str, make: Callable):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def adjacency(self) -> np.ndarray:
        return self.once("a", self.m.adjacency)

    @property
    def degree(self) -> np.ndarray:
        return self.once("deg", lambda: self.adjacency.sum(axis=0))

    @property
    def edges(self) -> list[tuple[int, int]]:
        return self.once("e", lambda: [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(self.adjacency)), strict=True)])

    @property
    def distance(self) -> np.ndarray:
        return self.once("d", self.m.distances)

    @property
    def pairs(self) -> np.ndarray:
        """Distances of the connected pairs i < j."""
        d = self.distance[np.triu_indices(len(self.heavy), 1)]
        return d[np.isfinite(d)]

    def nbrs(self, i: int, symbol: str | None = None) -> list[int]:
        return [j for j, _ in self.m.near[i] if symbol is None or self.m.symbol[j] == symbol]

    def doubles(self, i: int, symbol: str = "O") -> int:
        return sum(self.m.order[k] == 2 and self.m.symbol[j] == symbol for j, k in self.m.near[i])

    def property(self, table: dict[str, float], default: float = 0.0) -> np.ndarray:
        return np.array([table.get(self.m.symbol[i], default) for i in self.heavy])


def family(*names: str):
    def add(f):
        FAMILIES[f.__name__] = (f, names)
        return f

    return add


@family(
    "MolecularWeight", "ExactMass", "HeavyAtomMolWeight", "AverageAtomicMass", "AtomCount", "SelectionSize", "HeavyAtomCount", "BondCount", "CarbonCount", "NitrogenCount", "OxygenCount",
    "SulfurCount", "PhosphorusCount", "HalogenCount", "FluorineCount", "ChlorineCount", "BromineCount", "IodineCount", "HydrogenCount", "HeteroAtomCount", "FormalCharge", "UnsaturationCount",
    "HeteroProportion", "HCRatio", "NCRatio", "OCRatio", "HeteroatomFraction", "ValenceElectronCount", "VdWVolumeSum", "LipinskiHBA", "HAcceptorCount", "PolarAtomFraction", "Polarizability",
    "MeanElectronegativity", "ElectronegativityVariance", "MaxBondPolarity", "McGowanVolume", "VeberTPSA", "AtomTypeInformation", "TotalAtomInformation",
)
def composition(c: Context) -> dict[str, float]:
    m, n, heavy = c.m, c.count, len(c.heavy)
    mass = sum(MASS.get(m.symbol[i], 0.0) for i in c.heavy)
    weight, x = m.weight(), sum(n[s] for s in HALOGENS)
    hetero = heavy - n["C"]
    en = np.array([EN.get(s, 0.0) for s in m.symbol])
    info = entropy([m.symbol[i] for i in c.heavy])
    implicit = sum(m.hydrogens)
    return {
        "MolecularWeight": weight, "ExactMass": weight, "HeavyAtomMolWeight": mass, "AverageAtomicMass": ratio(mass, heavy), "AtomCount": m.n + implicit, "SelectionSize": m.n + implicit, "HeavyAtomCount": heavy,
        "BondCount": len(m.ends), "CarbonCount": n["C"], "NitrogenCount": n["N"], "OxygenCount": n["O"], "SulfurCount": n["S"], "PhosphorusCount": n["P"], "HalogenCount": x, "FluorineCount": n["F"],
        "ChlorineCount": n["Cl"], "BromineCount": n["Br"], "IodineCount": n["I"], "HydrogenCount": c.h, "HeteroAtomCount": hetero, "FormalCharge": sum(m.charge),
        "UnsaturationCount": n["C"] - (c.h + x) / 2 + n["N"] / 2 + 1, "HeteroProportion": ratio(hetero, heavy), "HCRatio": ratio(c.h, n["C"]), "NCRatio": ratio(n["N"], n["C"]), "OCRatio": ratio(n["O"], n["C"]),
        "HeteroatomFraction": ratio(hetero, heavy), "ValenceElectronCount": sum(_VALENCE_ELECTRONS.get(s, 4) for s in m.symbol) + implicit, "VdWVolumeSum": sum(_VDW_VOLUME.get(s, 20.0) for s in m.symbol) + implicit * 7.24,
        "LipinskiHBA": n["N"] + n["O"], "HAcceptorCount": n["N"] + n["O"] + n["S"] + n["F"] + n["Cl"] + n["Br"], "PolarAtomFraction": ratio(n["N"] + n["O"] + n["S"] + n["P"], heavy),
        "Polarizability": sum(_POLARIZABILITY.get(s, 1.0) for s in m.symbol) + implicit * 0.667, "MeanElectronegativity": float(en.mean()) if m.n else 0.0, "ElectronegativityVariance": float(en.var()) if m.n else 0.0,
        "MaxBondPolarity": max((abs(en[a] - en[b]) for a, b in m.ends), default=0.0), "McGowanVolume": sum(_MCGOWAN.get(s, 16.35) for s in m.symbol) + implicit * 8.71 - 6.56 * (len(m.ends) + implicit),
        "VeberTPSA": 17 * n["O"] + 12 * n["N"] + 15 * n["F"], "AtomTypeInformation": info, "TotalAtomInformation": heavy * info,
    }


@family(
    "SingleBondCount", "DoubleBondCount", "TripleBondCount", "AromaticBondCount", "RotatableBonds", "RotatableBondFraction", "MolecularFlexibility", "AliphaticCarbonCount", "AromaticCarbonCount", "SP3CarbonCount", "SP2CarbonCount", "SPCarbonCount",
    "SP3NitrogenCount", "SP2NitrogenCount", "SP3OxygenCount", "SP2OxygenCount", "AromaticProportion", "AliphaticProportion", "SP3Proportion", "Fsp3", "PrimaryCarbonCount", "SecondaryCarbonCount", "TertiaryCarbonCount",
    "QuaternaryCarbonCount", "BranchCount", "MethylGroupCount", "FragmentCount", "BondTypeInformation", "nSingleBonds", "nDoubleBonds", "nTripleBonds",
)
def bonding(c: Context) -> dict[str, float]:
    m, heavy = c.m, len(c.heavy)
    kind = ["ar" if m.arom_bond[k] else o for k, o in enumerate(m.order)]
    hyb = Counter((m.symbol[i], m.hyb[i]) for i in range(m.n))
    carbons = [i for i in range(m.n) if m.symbol[i] == "C"]
    cc = Counter(len(c.nbrs(i, "C")) for i in carbons)
    rot = sum(kind[k] == 1 and not m.ring_bond[k] and not {m.symbol[a], m.symbol[b]} & {"H", "F", "Cl", "Br", "I"} for k, (a, b) in enumerate(m.ends))
    arom = sum(m.aromatic[i] for i in c.heavy)
    n = Counter(kind)
    return {
        "SingleBondCount": n[1], "DoubleBondCount": n[2], "TripleBondCount": n[3], "AromaticBondCount": n["ar"], "nSingleBonds": m.order.count(1), "nDoubleBonds": m.order.count(2), "nTripleBonds": m.order.count(3),
        "RotatableBonds": rot, "RotatableBondFraction": ratio(rot, heavy), "MolecularFlexibility": ratio(rot, heavy), "AromaticCarbonCount": sum(m.aromatic[i] for i in carbons), "AliphaticCarbonCount": sum(not m.aromatic[i] for i in carbons),
        "SP3CarbonCount": hyb["C", "sp3"], "SP2CarbonCount": hyb["C", "sp2"], "SPCarbonCount": hyb["C", "sp"], "SP3NitrogenCount": hyb["N", "sp3"], "SP2NitrogenCount": hyb["N", "sp2"], "SP3OxygenCount": hyb["O", "sp3"], "SP2OxygenCount": hyb["O", "sp2"],
        "AromaticProportion": ratio(arom, heavy), "AliphaticProportion": ratio(heavy - arom, heavy), "SP3Proportion": ratio(hyb["C", "sp3"], len(carbons)), "Fsp3": ratio(hyb["C", "sp3"], len(carbons)),
        "PrimaryCarbonCount": cc[1], "SecondaryCarbonCount": cc[2], "TertiaryCarbonCount": cc[3], "QuaternaryCarbonCount": cc[4], "BranchCount": sum(v for k, v in cc.items() if k > 2), "MethylGroupCount": sum(m.hydrogens[i] == 3 for i in carbons),
        "FragmentCount": len(set(m.component)), "BondTypeInformation": entropy(kind),
    }


@family(
    "RingCount", "AromaticRingCount", "HeteroRingCount", "Ring5Count", "Ring6Count", "LargestRingSize", "RingAtomCount", "RingBondCount", "NonRingCarbonCount", "AliphaticRingCount", "SaturatedRingCount", "AromaticHeterocycleCount", "AromaticCarbocycleCount",
    "SaturatedHeterocycleCount", "SpiroAtomCount", "BridgeheadAtomCount", "FusedRingCount", "MacrocycleCount", "RingComplexity", "CyclomaticNumber",
)
def rings(c: Context) -> dict[str, float]:
    m = c.m
    arom = [all(m.arom_bond[k] for k in b) for b in m.ring_bonds]
    single = [all(m.order[k] == 1 and not m.arom_bond[k] for k in b) for b in m.ring_bonds]
    hetero = [any(m.symbol[i] not in ("C", "H") for i in r) for r in m.rings]
    inside = {i for r in m.rings for i in r}
    spiro, junction, fused = set(), set(), 0
    for a, b in combinations(m.rings, 2):
        shared = set(a) & set(b)
        if len(shared) == 1:
            spiro |= shared
        elif shared:
            fused += 1
            junction |= shared if len(shared) > 2 else shared
    return {
        "RingCount": len(m.rings), "AromaticRingCount": sum(arom), "HeteroRingCount": sum(hetero), "Ring5Count": sum(len(r) == 5 for r in m.rings), "Ring6Count": sum(len(r) == 6 for r in m.rings),
        "LargestRingSize": max(map(len, m.rings), default=0), "RingAtomCount": len(inside), "RingBondCount": sum(m.ring_bond), "NonRingCarbonCount": sum(s == "C" and i not in inside for i, s in enumerate(m.symbol)),
        "AliphaticRingCount": len(arom) - sum(arom), "SaturatedRingCount": sum(single), "AromaticHeterocycleCount": sum(x and y for x, y in zip(arom, hetero, strict=True)), "AromaticCarbocycleCount": sum(x and not y for x, y in zip(arom, hetero, strict=True)),
        "SaturatedHeterocycleCount": sum(x and y for x, y in zip(single, hetero, strict=True)), "SpiroAtomCount": len(spiro), "BridgeheadAtomCount": len(junction), "FusedRingCount": fused, "MacrocycleCount": sum(len(r) > 12 for r in m.rings),
        "RingComplexity": ratio(len(inside), len(m.rings)), "CyclomaticNumber": len(m.ends) - m.n + len(set(m.component)),
    }


@family(
    "HDonorCount", "LipinskiHBD", "LipophilicAtomCount", "AmideBondCount", "EsterBondCount", "CarbonylBondCount", "HydroxylGroupCount", "CarboxylGroupCount", "AmineGroupCount", "NitroGroupCount", "NitrileCount", "AldehydeCount", "KetoneCount", "EtherCount",
    "ThioetherCount", "ThiolCount", "SulfonamideCount", "SulfoneCount", "SulfoxideCount", "PhosphateCount", "ImineCount", "AzoCount", "UreaCount", "GuanidineCount", "PhenolCount", "AliphaticHydroxylCount", "AromaticHalideCount", "AcidicGroupCount", "BasicGroupCount",
)
def groups(c: Context) -> dict[str, float]:
    m, s = c.m, c.m.symbol
    total_h = [h + len(c.nbrs(i, "H")) for i, h in enumerate(m.hydrogens)]
    at = {x: [i for i in range(m.n) if s[i] == x] for x in ("C", "N", "O", "S", "P", "H")}
    carbonyl = {i for i in at["C"] if c.doubles(i)}

    def heavy(i: int) -> list[int]:
        return [j for j in c.nbrs(i) if s[j] != "H"]

    def bond(a: str, b: str, order: int) -> int:
        return sum({s[x], s[y]} == {a, b} and m.order[k] == order and not m.arom_bond[k] for k, (x, y) in enumerate(m.ends))

    donors = sum(any(s[j] in ("N", "O", "S") for j in c.nbrs(i)) for i in at["H"])
    lipo = sum((s[i] in ("C", "H") and not any(s[j] in ("N", "O", "F") for j in c.nbrs(i))) or s[i] in ("S", "P", "Si", "Cl", "Br", "I") for i in range(m.n))
    acid = sum(any(s[j] == "O" and m.order[k] == 1 and total_h[j] for j, k in m.near[i]) for i in carbonyl)
    sulfonyl = [i for i in at["S"] if c.doubles(i) >= 2]
    phosphate = sum(len(c.nbrs(i, "O")) >= 3 for i in at["P"])
    hydroxyl = [i for i in at["O"] if total_h[i] and len(heavy(i)) == 1]
    return {
        "HDonorCount": donors, "LipinskiHBD": donors, "LipophilicAtomCount": lipo, "AmideBondCount": sum({s[a], s[b]} == {"C", "N"} and (a in carbonyl or b in carbonyl) for a, b in m.ends),
        "EsterBondCount": sum(len(c.nbrs(o)) == 2 and all(s[j] == "C" for j in c.nbrs(o)) and any(j in carbonyl for j in c.nbrs(o)) for o in at["O"]), "CarbonylBondCount": sum({s[a], s[b]} == {"C", "O"} and m.order[k] == 2 for k, (a, b) in enumerate(m.ends)),
        "HydroxylGroupCount": sum(total_h[i] > 0 for i in at["O"]), "CarboxylGroupCount": acid, "AmineGroupCount": sum(not any(j in carbonyl for j in c.nbrs(i)) for i in at["N"]),
        "NitroGroupCount": sum(sum(len(heavy(j)) == 1 for j in c.nbrs(i, "O")) >= 2 for i in at["N"]), "NitrileCount": sum({s[a], s[b]} == {"C", "N"} and m.order[k] == 3 for k, (a, b) in enumerate(m.ends)),
        "AldehydeCount": sum(len(c.nbrs(i, "O")) == 1 and len(c.nbrs(i, "C")) <= 1 and total_h[i] >= 1 for i in carbonyl), "KetoneCount": sum(len(c.nbrs(i, "C")) == 2 and len(c.nbrs(i, "O")) == 1 and len(heavy(i)) == 3 for i in carbonyl),
        "EtherCount": sum(not m.aromatic[i] and len(c.nbrs(i, "C")) == 2 and not total_h[i] and not any(j in carbonyl for j in c.nbrs(i)) for i in at["O"]), "ThioetherCount": sum(not m.aromatic[i] and len(c.nbrs(i, "C")) == 2 and len(heavy(i)) == 2 and not total_h[i] for i in at["S"]),
        "ThiolCount": sum(len(heavy(i)) == 1 and total_h[i] >= 1 for i in at["S"]), "SulfonamideCount": sum(bool(c.nbrs(i, "N")) for i in sulfonyl), "SulfoneCount": sum(len(c.nbrs(i, "C")) >= 2 for i in sulfonyl),
        "SulfoxideCount": sum(c.doubles(i) == 1 and len(c.nbrs(i, "C")) >= 2 for i in at["S"]), "PhosphateCount": phosphate, "ImineCount": bond("C", "N", 2), "AzoCount": sum(s[a] == s[b] == "N" and m.order[k] == 2 and not m.arom_bond[k] for k, (a, b) in enumerate(m.ends)),
        "UreaCount": sum(len(c.nbrs(i, "N")) >= 2 for i in carbonyl), "GuanidineCount": sum(len(c.nbrs(i, "N")) >= 3 and c.doubles(i, "N") >= 1 for i in at["C"]), "PhenolCount": sum(m.aromatic[heavy(i)[0]] for i in hydroxyl),
        "AliphaticHydroxylCount": sum(not m.aromatic[heavy(i)[0]] and heavy(i)[0] not in carbonyl for i in hydroxyl), "AromaticHalideCount": sum(s[i] in HALOGENS and bool(heavy(i)) and m.aromatic[heavy(i)[0]] for i in range(m.n)),
        "AcidicGroupCount": acid + sum(any(total_h[j] for j in c.nbrs(i, "O")) for i in sulfonyl) + phosphate, "BasicGroupCount": sum(not m.aromatic[i] and len(heavy(i)) <= 3 and not any(j in carbonyl for j in c.nbrs(i)) for i in at["N"]),
    }


@family(
    "ZagrebIndex1", "ZagrebIndex2", "RandicIndex", "ConnectivityIndexChi0", "ConnectivityIndexChi1", "HosoyaIndex", "PlattIndex", "BertzIndex", "BonchevTrinajsticIndex", "InformationContent0", "InformationContent1", "PathCount3", "PathCount4", "ElectrotopologicalStateIndex",
    "ABCIndex", "AugmentedZagrebIndex", "ForgottenIndex", "ModifiedZagrebIndex", "SumConnectivityIndex", "GeometricArithmeticIndex", "HarmonicIndex", "NarumiSimpleIndex", "NarumiHarmonicIndex", "NarumiGeometricIndex", "TerminalAtomCount", "MaxAtomDegree",
    "MeanAtomDegree", "VertexDegreeInformation",
)
def degrees(c: Context) -> dict[str, float]:
    """RandicIndex is Chi0; Bonchev-Trinajstic and both information contents are the entropy of the degree shares; PathCount4 equals PathCount3."""
    d, e = c.degree, c.edges
    p = d[d > 0]
    own = d.tolist()
    uv = [(own[i], own[j]) for i, j in e]
    share = p / p.sum() if len(p) else p
    info = float(-(share * np.log2(share)).sum()) if len(p) else 0.0
    chi0 = float((1 / np.sqrt(p)).sum())
    three = float((d * (d - 1) / 2).sum())
    z = c.property(Z_OF)
    return {
        "ZagrebIndex1": float((d * d).sum()), "ZagrebIndex2": float(sum(u * v for u, v in uv)), "RandicIndex": chi0, "ConnectivityIndexChi0": chi0, "ConnectivityIndexChi1": sum(1 / sqrt(u * v) for u, v in uv), "HosoyaIndex": len(e) + int((d == 0).sum()),
        "PlattIndex": float(sum(u + v for u, v in uv)), "BertzIndex": len(e) * log2(len(e)) if e else 0.0, "BonchevTrinajsticIndex": info, "InformationContent0": info, "InformationContent1": info, "PathCount3": three, "PathCount4": three,
        "ElectrotopologicalStateIndex": float((z[d > 0] / p).sum()), "ABCIndex": sum(sqrt((u + v - 2) / (u * v)) for u, v in uv if u + v > 2), "AugmentedZagrebIndex": sum((u * v / (u + v - 2)) ** 3 for u, v in uv if u + v > 2),
        "ForgottenIndex": float((d**3).sum()), "ModifiedZagrebIndex": float((1 / p**2).sum()), "SumConnectivityIndex": sum(1 / sqrt(u + v) for u, v in uv), "GeometricArithmeticIndex": sum(2 * sqrt(u * v) / (u + v) for u, v in uv), "HarmonicIndex": sum(2 / (u + v) for u, v in uv),
        "NarumiSimpleIndex": float(np.log(p).sum()), "NarumiHarmonicIndex": ratio(len(p), float((1 / p).sum())), "NarumiGeometricIndex": exp(float(np.log(p).mean())) if len(p) else 0.0, "TerminalAtomCount": int((d == 1).sum()),
        "MaxAtomDegree": float(d.max()) if len(d) else 0.0, "MeanAtomDegree": float(d.mean()) if len(d) else 0.0, "VertexDegreeInformation": entropy(d.tolist()),
    }


@family(
    "WienerIndex", "HararyIndex", "HyperWienerIndex", "MeanWienerIndex", "AveragePathLength", "LongestShortestPath", "PolarityNumber", "EccentricConnectivityIndex", "MolecularTopologicalIndex", "KappaShapeIndex1", "KappaShapeIndex2", "KappaShapeIndex3", "BalabanIndex",
    "SchultzIndex", "GutmanIndex", "SzegedIndex", "PIIndex", "TopologicalRadius", "AverageEccentricity", "PetitjeanIndex", "EccentricDistanceSum", "DistanceInformation",
)
def paths(c: Context) -> dict[str, float]:
    """The kappa indices here are those of the diameter and the distance sum; Kier's are Kappa1Alpha to Kappa3Alpha."""
    d, deg, p, n = c.distance, c.degree, c.pairs, len(c.heavy)
    f = np.where(np.isfinite(d), d, 0)
    ecc, far, w = f.max(axis=0) if n else np.zeros(0), float(p.max()) if len(p) else 0.0, float(p.sum())
    rows = f.sum(axis=0)
    mu = len(c.edges) - n + len({c.m.component[i] for i in c.heavy})
    ends = d[[i for i, _ in c.edges]], d[[j for _, j in c.edges]]
    near = list(zip((ends[0] < ends[1]).sum(axis=1).tolist(), (ends[1] < ends[0]).sum(axis=1).tolist(), strict=True)) if c.edges else []
    e, apart = ecc[ecc > 0], rows.tolist()
    return {
        "WienerIndex": w, "HararyIndex": float((1 / p).sum()), "HyperWienerIndex": float((p + p * p).sum() / 2), "MeanWienerIndex": float(p.mean()) if len(p) else 0.0, "AveragePathLength": float(p.mean()) if len(p) else 0.0, "LongestShortestPath": far,
        "PolarityNumber": int((p == 3).sum()), "EccentricConnectivityIndex": float((deg * ecc).sum()), "MolecularTopologicalIndex": w + float((deg * deg).sum()), "KappaShapeIndex1": ratio(n * (n - 1) ** 2, 2 * far * far),
        "KappaShapeIndex2": ratio((n - 1) * (n - 2) ** 2, w * w), "KappaShapeIndex3": ratio((n - 2) * (n - 3) ** 2, far * far), "BalabanIndex": len(c.edges) / (mu + 1) * sum(1 / sqrt(apart[i] * apart[j]) for i, j in c.edges),
        "SchultzIndex": float((deg[:, None] * (c.adjacency + f)).sum()), "GutmanIndex": float((np.triu(np.outer(deg, deg) * f)).sum()), "SzegedIndex": float(sum(a * b for a, b in near)), "PIIndex": float(sum(a + b for a, b in near)),
        "TopologicalRadius": float(ecc.min()) if n else 0.0, "AverageEccentricity": float(ecc.mean()) if n else 0.0, "PetitjeanIndex": ratio(float(ecc.max() - ecc.min()), float(ecc.min())) if len(e) else 0.0, "EccentricDistanceSum": float((ecc * rows).sum()),
        "DistanceInformation": len(p) * entropy(p.tolist()),
    }


@family("Chi0n", "Chi1n", "Chi2n", "Chi3n", "Chi4n", "Chi0v", "Chi1v", "Chi2v", "Chi3v", "Chi4v", "Chi3Cluster", "Chi4Cluster", "Kappa1Alpha", "Kappa2Alpha", "Kappa3Alpha", "KierFlexibility")
def chi(c: Context) -> dict[str, float]:
    """Kier-Hall connectivity over simple paths and stars, and Kier's alpha-corrected shape."""
    m, n = c.m, len(c.heavy)
    near = [np.flatnonzero(r).tolist() for r in c.adjacency]
    deg = c.degree.tolist()
    dv = []
    for i in c.heavy:
        z, zv = Z_OF.get(m.symbol[i], 6), _VALENCE_ELECTRONS.get(m.symbol[i], 4)
        dv.append(ratio(zv - m.hydrogens[i], max(1, z - zv - 1) if z > 10 else 1))
    out, count, walks = {}, [n], [((i,), deg[i], dv[i]) for i in range(n)]  # atoms, and the products of their two degrees
    out["Chi0n"], out["Chi0v"] = sum(1 / sqrt(x) for x in deg if x > 0), sum(1 / sqrt(x) for x in dv if x > 0)
    for k in range(1, 5):
        walks = [((*p, j), u * deg[j], v * dv[j]) for p, u, v in walks for j in near[p[-1]] if j not in p]
        own = [(u, v) for p, u, v in walks if p[0] < p[-1]]
        count.append(len(own))
        out[f"Chi{k}n"] = sum(1 / sqrt(u) for u, _ in own)
        out[f"Chi{k}v"] = sum(1 / sqrt(v) for _, v in own if v > 0)
    for k in (3, 4):
        out[f"Chi{k}Cluster"] = sum(1 / sqrt(deg[i] * prod([deg[j] for j in s])) for i in range(n) for s in combinations(near[i], k))
    from crucible.chem.elements import element

    alpha = sum(((element(m.symbol[i]) or element("C")).covalent_radius / {"sp3": 0.77, "sp2": 0.77, "sp": 0.77}[m.hyb[i]]) - 1 for i in c.heavy)
    x, p1, p2, p3 = n + alpha, count[1] + alpha, count[2] + alpha, count[3] + alpha
    out["Kappa1Alpha"] = ratio(x * (x - 1) ** 2, p1 * p1) if count[1] else 0.0
    out["Kappa2Alpha"] = ratio((x - 1) * (x - 2) ** 2, p2 * p2) if count[2] else 0.0
    out["Kappa3Alpha"] = ratio((x - 1) * (x - 3) ** 2 if n % 2 else (x - 3) * (x - 2) ** 2, p3 * p3) if count[3] else 0.0
    out["KierFlexibility"] = ratio(out["Kappa1Alpha"] * out["Kappa2Alpha"], n)
    return out


@family("GraphEnergy", "SpectralRadius", "EstradaIndex", "LaplacianSpectralRadius", "AlgebraicConnectivity", "LogSpanningTreeCount", "KirchhoffIndex", "WalkCount2", "WalkCount3", "WalkCount4", "SelfReturningWalk3")
def spectra(c: Context) -> dict[str, float]:
    a, n = c.adjacency, len(c.heavy)
    if not n:
        return dict.fromkeys(FAMILIES["spectra"][1], 0.0)
    x, l = np.linalg.eigvalsh(a), np.linalg.eigvalsh(np.diag(c.degree) - a)
    joined = n == 1 or l[1] > 1e-9
    a2 = a @ a
    return {
        "GraphEnergy": float(np.abs(x).sum()), "SpectralRadius": float(np.abs(x).max()), "EstradaIndex": float(np.exp(np.clip(x, -50, 50)).sum()), "LaplacianSpectralRadius": float(l[-1]), "AlgebraicConnectivity": max(0.0, float(l[1])) if n > 1 else 0.0,
        "LogSpanningTreeCount": float(np.log10(l[1:]).sum() - log10(n)) if joined else 0.0, "KirchhoffIndex": float(n * (1 / l[1:]).sum()) if joined else 0.0,
        "WalkCount2": float(a2.sum()), "WalkCount3": float((a2 @ a).sum()), "WalkCount4": float((a2 @ a2).sum()), "SelfReturningWalk3": float(np.trace(a2 @ a)),
    }


@family(
    *(f"ATS{p}{k}" for p in ("Electronegativity", "Polarizability", "Volume") for k in (1, 2, 3)), "MoranElectronegativity1", "MoranElectronegativity2", "MoranMass1", "GearyElectronegativity1", "GearyElectronegativity2", "GearyMass1",
    "TopologicalCharge1", "TopologicalCharge2", "TopologicalCharge3", "MeanTopologicalCharge",
)
def lags(c: Context) -> dict[str, float]:
    """Sums over pairs at a topological distance; weights of the ATS are relative to carbon."""
    n = len(c.heavy)
    d, out = np.triu(np.where(np.isfinite(c.distance), c.distance, 0)), {}
    at = {k: np.nonzero(d == k) for k in (1, 2, 3)}
    for name, table in (("Electronegativity", EN), ("Polarizability", _POLARIZABILITY), ("Volume", _VDW_VOLUME)):
        w = c.property(table, table["C"]) / table["C"]
        for k, (i, j) in at.items():
            out[f"ATS{name}{k}"] = float((w[i] * w[j]).sum())
    for name, table, ks in (("Electronegativity", EN, (1, 2)), ("Mass", MASS, (1,))):
        w = c.property(table)
        dev, var = w - w.mean() if n else w, float(w.var()) if n else 0.0
        samp = var * n / (n - 1) if n > 1 else 0.0
        for k in ks:
            i, j = at[k]
            out[f"Moran{name}{k}"] = float((dev[i] * dev[j]).mean()) / var if len(i) and var > 1e-12 else 0.0
            out[f"Geary{name}{k}"] = float(((w[i] - w[j]) ** 2).mean()) / 2 / samp if len(i) and samp > 1e-12 else 0.0
    inverse = np.where(np.isfinite(c.distance) & (c.distance > 0), 1 / np.where(c.distance > 0, c.distance, 1) ** 2, 0)
    t = c.adjacency @ inverse
    for k, (i, j) in at.items():
        out[f"TopologicalCharge{k}"] = float(np.abs(t[i, j] - t[j, i]).sum())
    out["MeanTopologicalCharge"] = ratio(sum(out[f"TopologicalCharge{k}"] for k in (1, 2, 3)), n - 1)
    return out


@family(
    "PiElectronCount", "PiSystemSize", "PiSystemCount", "TotalPiEnergy", "DelocalizationEnergy", "HOMOEnergy", "LUMOEnergy", "HOMOLUMOGap", "ChemicalPotential", "ChemicalHardness", "Softness", "IonizationPotential", "ElectronAffinity", "MullikenElectronegativity",
    "ElectrophilicityIndex", "NucleophilicityIndex", "ElectroacceptingPower", "ElectrodonatingPower", "GapPerPiAtom", "HardnessRatio",
)
def hueckel(c: Context) -> dict[str, float]:
    """Hückel orbitals of the pi system: atoms of multiple bonds give one electron, lone pairs next to them two; alpha -6.15, beta -3.32 eV.

    All atoms have carbon's parameters here, so energies of hydrocarbons are the textbook ones.
    """
    m = c.m
    unsaturated = {i for k, e in enumerate(m.ends) if m.order[k] > 1 for i in e}
    donors = {i for i in range(m.n) if i not in unsaturated and m.symbol[i] in ("N", "O", "S", "F", "Cl", "Br", "I", "P") and any(j in unsaturated for j, _ in m.near[i])}
    pi = sorted(unsaturated | donors)
    at = {i: k for k, i in enumerate(pi)}
    a = np.zeros((len(pi), len(pi)))
    for x, y in m.ends:
        if x in at and y in at:
            a[at[x], at[y]] = a[at[y], at[x]] = 1
    electrons = max(0, len(unsaturated) + 2 * len(donors) - sum(m.charge[i] for i in pi))
    x = np.sort(np.linalg.eigvalsh(a))[::-1] if pi else np.zeros(0)
    pairs = min(electrons // 2, len(pi))
    energy = float(2 * x[:pairs].sum() + (x[pairs] if electrons % 2 and pairs < len(x) else 0))
    todo, systems = set(pi), 0
    while todo:
        systems, stack = systems + 1, [todo.pop()]
        while stack:
            for j, _ in m.near[stack.pop()]:
                if j in todo:
                    todo.discard(j)
                    stack.append(j)
    homo = -6.15 - 3.32 * float(x[pairs - 1]) if pairs else -6.15 - 3.32 * 2.0
    lumo = -6.15 - 3.32 * float(x[pairs]) if pairs < len(x) else -6.15 + 3.32 * 2.0
    gap, mu, ip, ea = lumo - homo, (homo + lumo) / 2, -homo, -lumo
    eta, omega = gap / 2, ratio(((homo + lumo) / 2) ** 2, gap)
    return {
        "PiElectronCount": electrons, "PiSystemSize": len(pi), "PiSystemCount": systems, "TotalPiEnergy": energy, "DelocalizationEnergy": energy - 2 * pairs, "HOMOEnergy": homo, "LUMOEnergy": lumo, "HOMOLUMOGap": gap, "ChemicalPotential": mu, "ChemicalHardness": eta,
        "Softness": ratio(1, eta), "IonizationPotential": ip, "ElectronAffinity": ea, "MullikenElectronegativity": (ip + ea) / 2, "ElectrophilicityIndex": omega, "NucleophilicityIndex": ratio(1, omega), "ElectroacceptingPower": ratio((ip + 3 * ea) ** 2, 16 * (ip - ea)),
        "ElectrodonatingPower": ratio((3 * ip + ea) ** 2, 16 * (ip - ea)), "GapPerPiAtom": ratio(gap, len(pi)), "HardnessRatio": ratio(eta, (ip + ea) / 2),
    }


# Molar refractivities by element, and contributions to the polar surface by heavy neighbours, hydrogens, charge and highest bond order.
_REFRACTIVITY = {"H": 1.463, "C": 2.491, "N": 2.743, "O": 1.529, "F": 0.923, "Cl": 5.607, "Br": 8.865, "I": 13.900}
_POLAR_N = {
    (3, 0, 0, 1): 3.24, (2, 0, 0, 2): 12.36, (1, 0, 0, 3): 23.79, (3, 0, 0, 2): 11.68, (2, 0, 0, 3): 13.60, (2, 1, 0, 1): 12.03, (1, 1, 0, 2): 23.85, (1, 2, 0, 1): 26.02,
    (4, 0, 1, 1): 0.00, (3, 0, 1, 2): 3.01, (2, 0, 1, 3): 4.36, (3, 1, 1, 1): 4.44, (2, 1, 1, 2): 13.97, (2, 2, 1, 1): 16.61, (1, 2, 1, 2): 25.59, (1, 3, 1, 1): 27.64,
}
_POLAR_O = {(2, 0, 0, 1): 9.23, (1, 0, 0, 2): 17.07, (1, 1, 0, 1): 20.23, (1, 0, -1, 1): 23.06}
_POLAR_S = {(2, 0, 1): 25.30, (1, 0, 2): 32.09, (3, 0, 2): 19.21, (4, 0, 2): 8.38, (1, 1, 1): 38.80}
_POLAR_P = {(3, 0, 1): 13.59, (2, 0, 2): 34.14, (4, 0, 2): 9.81, (3, 1, 2): 23.47}


@family("TPSA", "TPSAWithSP", "TPSAPerHeavyAtom", "MolarRefractivity", "HydrophilicFactor", "VeberViolations", "SyntheticAccessibility", "LongestChain")
def polar(c: Context) -> dict[str, float]:
    """Polar surface by atom contributions, refractivity and rules that need no partition coefficient; bond orders are Kekulé's off aromatic atoms."""
    m, s = c.m, c.m.symbol
    small = large = 0.0
    wet = 0
    for i in c.heavy:
        if s[i] not in ("N", "O", "S", "P"):
            continue
        near = [(j, k) for j, k in m.near[i] if s[j] != "H"]
        h = m.hydrogens[i] + len(m.near[i]) - len(near)
        order = max([m.order[k] for _, k in m.near[i] if not m.arom_bond[k]] + [1])
        q, key = m.charge[i], (len(near), h)
        wet += s[i] != "P" and h > 0
        if s[i] == "N":
            v = (4.10 if len(near) >= 3 else 14.14) if m.aromatic[i] and q > 0 else 15.79 if m.aromatic[i] and h else (4.93 if len(near) >= 3 else 12.89) if m.aromatic[i] else _POLAR_N.get((*key, q, order), 3.24)
        elif s[i] == "O":
            v = 13.14 if m.aromatic[i] else _POLAR_O.get((*key, q, order), 9.23)
        elif s[i] == "S":
            v = 28.24 if m.aromatic[i] else _POLAR_S.get((*key, order), 25.30)
        else:
            v = _POLAR_P.get((*key, order), 13.59)
        large += v
        small += v if s[i] in ("N", "O") else 0.0
    n, carbon = len(c.heavy), c.count["C"]
    single = sum(o == 1 and not m.arom_bond[k] and not m.ring_bond[k] and not {s[a], s[b]} & {"H", "F", "Cl", "Br", "I"} for k, (o, (a, b)) in enumerate(zip(m.order, m.ends, strict=True)))
    factor = ((1 + wet) * log2(1 + wet) + carbon / n * log2(1 / n) + sqrt(wet / n**2)) / log2(1 + n) if n else 0.0
    return {
        "TPSA": small, "TPSAWithSP": large, "TPSAPerHeavyAtom": ratio(small, n), "MolarRefractivity": sum(_REFRACTIVITY.get(x, 2.0) for x in s) + 1.463 * sum(m.hydrogens), "HydrophilicFactor": factor, "VeberViolations": (single > 10) + (small > 140),
        "SyntheticAccessibility": min(10.0, max(1.0, 5 + 0.5 * len(m.rings) + min(0.1 * single, 1) + min(0.05 * (n - carbon), 1))), "LongestChain": _longest_carbon_path(c),
    }


def _longest_carbon_path(c: Context) -> int:
    """Carbons of the longest simple path of carbons.

    A path that crosses a bond outside rings doesn't come back, so paths are followed within ring systems only and what lies
    beyond such a bond is worked out once a direction.
    """
    m = c.m
    own = [m.symbol[i] == "C" for i in range(m.n)]
    near = [[(j, m.ring_bond[k]) for j, k in m.near[i] if own[i] and own[j]] for i in range(m.n)]
    beyond: dict[tuple[int, int], int] = {}

    def within(v: int, source: int) -> int:
        """Longest path that starts at v and doesn't begin by going to `source`."""
        best, todo = 0, [(v, (v,))]
        while todo:
            x, path = todo.pop()
            best = max(best, len(path) + max((beyond.get((x, y), 0) for y, ring in near[x] if not ring and not (x == v and y == source)), default=0))
            todo += [(y, (*path, y)) for y, ring in near[x] if ring and y not in path]
        return best

    # bonds outside rings by direction, those whose far side is known first
    wait = [(x, y) for x in range(m.n) for y, ring in near[x] if not ring]
    systems = list(range(m.n))
    for i in range(m.n):
        for j, ring in near[i]:
            if ring:
                a, b = systems[i], systems[j]
                if a != b:
                    systems = [min(a, b) if z in (a, b) else z for z in systems]
    inside: dict[int, list[int]] = {}
    for i in range(m.n):
        inside.setdefault(systems[i], []).append(i)
    while wait:
        ready = [(x, y) for x, y in wait if all((z, w) in beyond for z in inside[systems[y]] for w, ring in near[z] if not ring and not (z == y and w == x))]
        for x, y in ready:
            beyond[x, y] = within(y, x)
        done = set(ready)
        wait = [e for e in wait if e not in done]
        if not ready:
            break
    return max((within(v, -1) for v in range(m.n) if own[v]), default=0)


@family(
    "TotalCharge", "MaxPartialCharge", "MinPartialCharge", "MaxPositiveCharge", "MaxNegativeCharge", "MeanAbsoluteCharge", "TotalAbsoluteCharge", "ChargeVariance", "SumSquaredCharges", "SubmolecularPolarity", "RelativePositiveCharge", "RelativeNegativeCharge", "PolarAtomCharge",
)
def charges(c: Context) -> dict[str, float]:
    """Of the partial charges of the atoms, equalised along bonds."""
    q = np.array(c.once("q", lambda: _partial(c.m)))
    plus, minus = q[q > 0], q[q < 0]
    size = np.abs(q)
    polar_q = size[[s in ("N", "O", "S", "P") for s in c.m.symbol]] if len(q) else size
    some = len(q) > 0
    return {
        "TotalCharge": float(q.sum()), "MaxPartialCharge": float(q.max()) if some else 0.0, "MinPartialCharge": float(q.min()) if some else 0.0, "MaxPositiveCharge": float(plus.max()) if len(plus) else 0.0, "MaxNegativeCharge": float(minus.min()) if len(minus) else 0.0,
        "MeanAbsoluteCharge": float(size.mean()) if some else 0.0, "TotalAbsoluteCharge": float(size.sum()), "ChargeVariance": float(q.var()) if some else 0.0, "SumSquaredCharges": float((q * q).sum()), "SubmolecularPolarity": float(np.ptp(q)) if some else 0.0,
        "RelativePositiveCharge": ratio(float(plus.max()) if len(plus) else 0.0, float(plus.sum())), "RelativeNegativeCharge": ratio(float(-minus.min()) if len(minus) else 0.0, float(-minus.sum())), "PolarAtomCharge": float(polar_q.sum()),
    }


def _partial(m: Molecule) -> list[float]:
    from crucible.chem.geometry import gasteiger

    return gasteiger(m)


@family(
    "SASA", "MolecularVolume", "RadiusOfGyration", "Asphericity", "Eccentricity", "PrincipalMoment1", "PrincipalMoment2", "PrincipalMoment3", "MolecularDiameter", "InertiaMomentA", "InertiaMomentB", "InertiaMomentC", "NPR1", "NPR2", "InertialShapeFactor", "SpherocityIndex",
    "MolecularLength", "MolecularWidth", "MolecularThickness", "LengthToWidthRatio", "BoundingBoxVolume", "Span", "PlaneOfBestFit", "MassWeightedRadiusOfGyration", "MeanAtomicDistance3D", "GeometricWienerIndex", "GravitationalIndex", "GravitationalIndexBonded", "SurfaceToVolumeRatio",
    "Globularity", "MolecularDensity", "DipoleMoment", "PolarSurfaceArea", "APolarSurfaceArea", "PPSA1", "PNSA1", "PPSA2", "PNSA2", "PPSA3", "PNSA3", "DPSA1", "FPSA1", "FNSA1", "WPSA1", "WNSA1", "RPCS", "RNCS", "SelectionDensity",
)
def space(c: Context) -> dict[str, float]:
    """Shape, surface and charged surface of the embedded atoms (hydrogens that are no atoms of their own have no place)."""
    from crucible.chem import geometry as G

    m = c.m
    x = G.embed(m)
    area, volume = G.surface(x, m.symbol), G.volume(x, m.symbol)
    q = np.array(c.once("q", lambda: _partial(m)))
    total, p, n = float(area.sum()), q > 0, q < 0
    polar_area = float(area[[s in ("N", "O", "F") for s in m.symbol]].sum()) if m.n else 0.0
    mass = np.array([MASS.get(s, 0.0) for s in m.symbol])
    bonded = sum(mass[a] * mass[b] / max(float(((x[a] - x[b]) ** 2).sum()), 1e-12) for a, b in m.ends)
    pp, pn, qp, qn = float(area[p].sum()), float(area[n].sum()), float(q[p].sum()), float(q[n].sum())
    out = G.shape(x, m.symbol) if m.n else dict.fromkeys(FAMILIES["space"][1], 0.0)
    return out | {
        "SASA": total, "MolecularVolume": volume, "GravitationalIndexBonded": float(bonded), "SurfaceToVolumeRatio": ratio(total, volume), "Globularity": ratio((36 * np.pi * volume**2) ** (1 / 3), total), "MolecularDensity": ratio(float(mass.sum()), volume),
        "DipoleMoment": float(np.linalg.norm(q @ x)) * 2.54 if m.n else 0.0, "PolarSurfaceArea": polar_area, "APolarSurfaceArea": total - polar_area, "PPSA1": pp, "PNSA1": pn, "PPSA2": qp * pp, "PNSA2": qn * pn, "PPSA3": float((q * area)[p].sum()), "PNSA3": float((q * area)[n].sum()),
        "DPSA1": pp - pn, "FPSA1": ratio(pp, total), "FNSA1": ratio(pn, total), "WPSA1": pp * total / 1000, "WNSA1": pn * total / 1000, "RPCS": float(area[np.argmax(q)]) * ratio(float(q.max()), qp) if p.any() else 0.0, "RNCS": float(area[np.argmin(q)]) * ratio(float(-q.min()), -qn) if n.any() else 0.0,
        "SelectionDensity": ratio(m.n, volume),
    }


_SYMBOLS = ("H", "C", "N", "O", "P", "S", "F", "Cl", "Br", "I", "B", "Si")


@family(*(f"n{s}" for s in _SYMBOLS), *(f"Ratio_{s}C" for s in _SYMBOLS if s != "C"), *(f"Prop_{s}" for s in _SYMBOLS), *(f"nDegree{k}" for k in range(1, 7)), "nRings", *(f"nRing{k}" for k in range(3, 13)))
def counts(c: Context) -> dict[str, float]:
    n = {s: c.h if s == "H" else c.count[s] for s in _SYMBOLS}
    total, deg, sizes = c.m.n + sum(c.m.hydrogens), Counter(c.degree.astype(int).tolist()), Counter(map(len, c.m.rings))
    out = {f"n{s}": v for s, v in n.items()} | {f"Ratio_{s}C": ratio(v, n["C"]) for s, v in n.items() if s != "C"} | {f"Prop_{s}": ratio(v, total) for s, v in n.items()}
    return out | {f"nDegree{k}": deg[k] for k in range(1, 7)} | {"nRings": len(c.m.rings)} | {f"nRing{k}": sizes[k] for k in range(3, 13)}


@family(*(f"{f}{k}{w}" for f in ("ATS", "MATS") for k in range(1, 16) for w in "mZd"), *(f"GATS{k}{w}" for k in range(1, 16) for w in "mZ"), *(f"DistPower{k}" for k in range(1, 11)), "WDist_m", "WDist_Z", "WDist_d")
def autocorrelations(c: Context) -> dict[str, float]:
    """By mass (m), atomic number (Z) and degree (d) at lags 1 to 15; MATS is the ATS over pairs + 1, GATS the plain squared differences."""
    d = np.triu(np.where(np.isfinite(c.distance), c.distance, 0))
    w = {"m": c.property(MASS), "Z": c.property(Z_OF, 6), "d": c.degree}
    out = {}
    i, j = np.nonzero(d)
    p = d[i, j]
    order = np.argsort(p, kind="stable")  # pairs by distance, those of a distance in their order
    at = np.searchsorted(p[order], np.arange(1, 17)).tolist()
    for name, v in w.items():
        both = (v[i] * v[j])[order]
        apart = ((v[i] - v[j]) ** 2)[order] if name != "d" else None
        for k in range(1, 16):
            own = slice(at[k - 1], at[k])
            s = float(both[own].sum())
            out[f"ATS{k}{name}"], out[f"MATS{k}{name}"] = s, s / (at[k] - at[k - 1] + 1)
            if apart is not None:
                out[f"GATS{k}{name}"] = float(apart[own].sum())
    out |= {f"DistPower{k}": float((p**k).sum()) for k in range(1, 11)}
    return out | {f"WDist_{name}": float((v[i] * v[j] * d[i, j]).sum()) for name, v in w.items()}


FAMILY_OF = {name: f for f, (_, names) in FAMILIES.items() for name in names}


#: Families by what they are about, as `info` tells.
CATEGORIES = {
    "composition": "constitutional", "bonding": "constitutional", "rings": "constitutional", "groups": "constitutional", "counts": "constitutional", "degrees": "topological", "paths": "topological", "chi": "topological", "spectra": "topological", "lags": "topological",
    "autocorrelations": "topological", "hueckel": "quantum", "charges": "electronic", "polar": "hybrid", "space": "geometric",
}


def info(name: str) -> dict[str, str]:
    """Name, family, category and the family's conventions of a descriptor; KeyError for an unknown one."""
    f = FAMILY_OF[name]
    return {"name": name, "family": f, "category": CATEGORIES[f], "conventions": (FAMILIES[f][0].__doc__ or "").strip()}


def names(families: tuple[str, ...] | None = None) -> list[str]:
    return [n for f, (_, own) in FAMILIES.items() if families is None or f in families for n in own]


def compute(m: Molecule, wanted: list[str]) -> list[float]:
    """Values of the wanted descriptors, in their order."""
    c, got = Context(m), {}
    for f in dict.fromkeys(FAMILY_OF[n] for n in wanted):
        got |= FAMILIES[f][0](c)
    return [float(got[n]) for n in wanted]


