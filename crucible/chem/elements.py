"""Element data, one row per element; the `elements` dimension table is made from it."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple


class Element(NamedTuple):
    symbol: str
    z: int
    mass: float
    covalent_radius: float
    vdw_radius: float
    electronegativity: float
    valences: tuple[int, ...]


# Symbol, standard weight, covalent radius, van der Waals radius, Pauling electronegativity, usual valences.
# In order of atomic number, from 1.
_TABLE = """
H 1.008 0.31 1.20 2.20 1
He 4.003 0.28 1.40 0.00 0
Li 6.941 1.28 1.82 0.98 1
Be 9.012 0.96 1.53 1.57 2
B 10.81 0.84 1.92 2.04 3
C 12.011 0.76 1.70 2.55 4
N 14.007 0.71 1.55 3.04 3,5
O 15.999 0.66 1.52 3.44 2
F 18.998 0.57 1.47 3.98 1
Ne 20.180 0.58 1.54 0.00 0
Na 22.990 1.66 2.27 0.93 1
Mg 24.305 1.41 1.73 1.31 2
Al 26.982 1.21 1.84 1.61 3
Si 28.086 1.11 2.10 1.90 4
P 30.974 1.07 1.80 2.19 3,5
S 32.06 1.05 1.80 2.58 2,4,6
Cl 35.45 1.02 1.75 3.16 1
Ar 39.948 1.06 1.88 0.00 0
K 39.098 2.03 2.75 0.82 1
Ca 40.078 1.76 2.31 1.00 2
Sc 44.956 1.70 2.11 1.36 3
Ti 47.867 1.60 2.00 1.54 4
V 50.942 1.53 2.00 1.63 5
Cr 51.996 1.39 2.00 1.66 3,6
Mn 54.938 1.39 2.00 1.55 2,4,7
Fe 55.845 1.32 2.00 1.83 2,3
Co 58.933 1.26 2.00 1.88 2,3
Ni 58.693 1.24 1.63 1.91 2
Cu 63.546 1.32 1.40 1.90 1,2
Zn 65.38 1.22 1.39 1.65 2
Ga 69.723 1.22 1.87 1.81 3
Ge 72.63 1.20 2.11 2.01 4
As 74.922 1.19 1.85 2.18 3,5
Se 78.96 1.20 1.90 2.55 2,4,6
Br 79.904 1.20 1.85 2.96 1
Kr 83.798 1.16 2.02 3.00 0
Rb 85.468 2.20 3.03 0.82 1
Sr 87.62 1.95 2.49 0.95 2
Y 88.906 1.90 2.00 1.22 3
Zr 91.224 1.75 2.00 1.33 4
Nb 92.906 1.64 2.00 1.60 5
Mo 95.96 1.54 2.00 2.16 6
Tc 98.0 1.47 2.00 1.90 7
Ru 101.07 1.46 2.00 2.20 4
Rh 102.91 1.42 2.00 2.28 3
Pd 106.42 1.39 1.63 2.20 2,4
Ag 107.87 1.45 1.72 1.93 1
Cd 112.41 1.44 1.58 1.69 2
In 114.82 1.42 1.93 1.78 3
Sn 118.71 1.39 2.17 1.96 2,4
Sb 121.76 1.39 2.06 2.05 3,5
Te 127.60 1.38 2.06 2.10 2,4,6
I 126.90 1.39 1.98 2.66 1
Xe 131.29 1.40 2.16 2.60 0
Cs 132.91 2.44 3.43 0.79 1
Ba 137.33 2.15 2.68 0.89 2
La 138.91 2.07 2.00 1.10 3
Ce 140.12 2.04 2.00 1.12 3,4
Pr 140.91 2.03 2.00 1.13 3
Nd 144.24 2.01 2.00 1.14 3
Pm 145.0 1.99 2.00 1.13 3
Sm 150.36 1.98 2.00 1.17 3
Eu 151.96 1.98 2.00 1.20 2,3
Gd 157.25 1.96 2.00 1.20 3
Tb 158.93 1.94 2.00 1.10 3
Dy 162.50 1.92 2.00 1.22 3
Ho 164.93 1.92 2.00 1.23 3
Er 167.26 1.89 2.00 1.24 3
Tm 168.93 1.90 2.00 1.25 3
Yb 173.05 1.87 2.00 1.10 2,3
Lu 174.97 1.87 2.00 1.27 3
Hf 178.49 1.75 2.00 1.30 4
Ta 180.95 1.70 2.00 1.50 5
W 183.84 1.62 2.00 2.36 6
Re 186.21 1.51 2.00 1.90 7
Os 190.23 1.44 2.00 2.20 4
Ir 192.22 1.41 2.00 2.20 3,4
Pt 195.08 1.36 1.75 2.28 2,4
Au 196.97 1.36 1.66 2.54 1,3
Hg 200.59 1.32 1.55 2.00 1,2
Tl 204.38 1.45 1.96 1.62 1,3
Pb 207.2 1.46 2.02 2.33 2,4
Bi 208.98 1.48 2.07 2.02 3,5
Po 209.0 1.40 1.97 2.00 2,4
At 210.0 1.50 2.02 2.20 1
Rn 222.0 1.50 2.20 0.00 0
Fr 223.0 2.60 3.48 0.70 1
Ra 226.0 2.21 2.83 0.90 2
Ac 227.0 2.15 2.00 1.10 3
Th 232.04 2.06 2.00 1.30 4
Pa 231.04 2.00 2.00 1.50 5
U 238.03 1.96 1.86 1.38 6
"""


@lru_cache(maxsize=1)
def elements() -> dict[str, Element]:
    out = {}
    for z, line in enumerate(_TABLE.split("\n")[1:-1], start=1):
        symbol, mass, cov, vdw, en, valences = line.split()
        out[symbol] = Element(symbol, z, float(mass), float(cov), float(vdw), float(en), tuple(map(int, valences.split(","))))
    return out


SYMBOLS = tuple(elements())
Z_OF = {s: e.z for s, e in elements().items()}
MASS = {s: e.mass for s, e in elements().items()}
EN = {s: e.electronegativity for s, e in elements().items()}
HALOGENS = ("F", "Cl", "Br", "I")


def element(symbol_or_z: str | int) -> Element | None:
    """The element of a symbol or atomic number; None when there is none."""
    table = elements()
    if isinstance(symbol_or_z, int):
        return table[SYMBOLS[symbol_or_z - 1]] if 1 <= symbol_or_z <= len(SYMBOLS) else None
    return table.get(symbol_or_z)


def bond_length(a: str, b: str, order: float = 1) -> float | None:
    """Sum of covalent radii, shortened for double, triple and aromatic bonds."""
    x, y = element(a), element(b)
    if x is None or y is None:
        return None
    return (x.covalent_radius + y.covalent_radius) * {2: 0.87, 3: 0.78, 1.5: 0.93}.get(order, 1.0)
