"""Proteins: backbone torsions, peptide bonds, secondary structure, residue order, contacts of ligands and pairs by sequence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crucible.operators.joins import dihedral, range_join

XYZ = ("x", "y", "z")

# One-letter codes of the residues.
ONE_LETTER = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "ARNDCQEGHILKMFPSTWYV", strict=True))


def backbone(atoms: DataFrame, names: tuple[str, ...] = ("N", "CA", "C", "O")) -> DataFrame:
    """(mol_id, chain_id, res_seq, res_name, one struct (x, y, z) a backbone atom): the first of each name by serial; null where it is missing.

    atoms holds mol_id, chain_id, res_seq, res_name, pdb_name, serial, x, y, z.
    """
    a = atoms.where(F.col("pdb_name").isin(*names) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    at = F.struct(*[F.col(c).alias(c) for c in XYZ])
    g = a.groupBy("mol_id", "chain_id", "res_seq").agg(F.min_by("res_name", "serial").alias("res_name"), *[F.min_by(F.when(F.col("pdb_name") == n, at), F.when(F.col("pdb_name") == n, F.col("serial"))).alias(n) for n in names])
    return g


def torsions(atoms: DataFrame) -> DataFrame:
    """(mol_id, chain_id, res_seq, res_name, phi, psi) in degrees of residues with N, CA and C; null where the neighbour's number isn't next or its atom is missing.

    Neighbours are met by an equality join on the number, not by a window over a chain.
    """
    b = backbone(atoms, ("N", "CA", "C"))
    key = ["mol_id", "chain_id", "res_seq"]
    before = b.select("mol_id", "chain_id", (F.col("res_seq") + 1).alias("res_seq"), F.col("C").alias("prev_c"))
    after = b.select("mol_id", "chain_id", (F.col("res_seq") - 1).alias("res_seq"), F.col("N").alias("next_n"))
    r = b.where("N is not null and CA is not null and C is not null").join(before, key, "left").join(after, key, "left")
    p = lambda c: [F.col(c)[k] for k in XYZ]
    phi, psi = dihedral([p("prev_c"), p("N"), p("CA"), p("C")]), dihedral([p("N"), p("CA"), p("C"), p("next_n")])
    return r.select(*key, "res_name", F.when(F.col("prev_c").isNotNull(), phi).alias("phi"), F.when(F.col("next_n").isNotNull(), psi).alias("psi"))


def peptide_bonds(atoms: DataFrame, longest: float = 2.0) -> DataFrame:
    """(mol_id, chain_id, res_seq, length): bonds from a residue's C to the N of the residue of the next number, shorter than `longest`."""
    b = backbone(atoms, ("N", "C"))
    n = b.where("N is not null").select("mol_id", "chain_id", (F.col("res_seq") - 1).alias("res_seq"), F.col("N").alias("next_n"))
    j = b.where("C is not null").join(n, ["mol_id", "chain_id", "res_seq"])
    length = F.sqrt(sum((F.pow(F.col("C")[k] - F.col("next_n")[k], 2) for k in XYZ), F.lit(0.0)))
    return j.select("mol_id", "chain_id", "res_seq", length.alias("length")).where(F.col("length") < longest)


def region(phi: str = "phi", psi: str = "psi") -> F.Column:
    """helix, sheet, left or other by plain boxes of the two torsions; null where one is."""
    a, b = F.col(phi), F.col(psi)
    return (
        F.when(a.isNull() | b.isNull(), None)
        .when(a.between(-160, -20) & b.between(-120, 50), "helix")
        .when(a.between(-180, -20) & ((b >= 90) | (b <= -150)), "sheet")
        .when(a.between(20, 120) & b.between(-30, 100), "left")
        .otherwise("other")
    )


def density_region(points: DataFrame, grid: DataFrame, limits: tuple[tuple[str, float], ...], cell: float = 3.6) -> DataFrame:
    """points (phi, psi, ...) with the region of their cell: grid holds (i, j, density) of cells of that many degrees from -180; limits are (name, least density), the highest first.

    A point outside the grid is 'outlier'.
    """
    at = lambda c: F.least(F.lit(int(360 / cell) - 1), F.floor((F.col(c) + 180) / cell)).cast("int")
    p = points.withColumn("i", at("phi")).withColumn("j", at("psi")).join(grid.select("i", "j", "density"), ["i", "j"], "left")
    out = F.lit("outlier")
    for name, least in reversed(limits):
        out = F.when(F.col("density") >= least, name).otherwise(out)
    return p.withColumn("region", out).drop("i", "j", "density")


def hydrogen_bond_energy(o: np.ndarray, c: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Electrostatic energy in kcal/mol of C=O to H-N (Kabsch and Sander): 0.084 * 332 * (1/ON + 1/CH - 1/OH - 1/CN), distances of at least 0.1."""
    d = lambda a, b: np.maximum(np.linalg.norm(a - b, axis=-1), 0.1)
    return 0.084 * 332.0 * (1 / d(o, n) + 1 / d(c, h) - 1 / d(o, h) - 1 / d(c, n))


def assign_structure(n: np.ndarray, ca: np.ndarray, c: np.ndarray, o: np.ndarray) -> list[str]:
    """H, G, I, E, T or C for each residue of a chain with the coordinates of its backbone (rows of NaN where an atom is missing).

    A hydrogen stands 1 Å from N along the preceding C=O, reversed; a bond is an energy below -0.5 of residues at least two
    apart. Two turns in a row make a helix (4 first, then 3 and 5 over coil), bridges a strand, a lone coil between strands
    too; other turns are T. Helices under three residues and strands under two are coil.
    """
    k = len(n)
    out = ["C"] * k
    if k < 4:
        return out
    h = n.copy()
    v = c[:-1] - o[:-1]
    length = np.linalg.norm(v, axis=1, keepdims=True)
    h[1:] = n[1:] + v / np.where(length < 0.01, 1.0, length)
    ok = np.isfinite(n).all(1) & np.isfinite(ca).all(1) & np.isfinite(c).all(1) & np.isfinite(o).all(1)
    bond: set[tuple[int, int]] = set()
    for i in np.flatnonzero(ok):  # acceptor C=O of i, donors near it
        near = np.flatnonzero(ok & (np.linalg.norm(ca - ca[i], axis=1) < 12.0) & (np.abs(np.arange(k) - i) >= 2) & np.isfinite(h).all(1))
        if len(near):
            e = hydrogen_bond_energy(o[i], c[i], n[near], h[near])
            bond |= {(int(i), int(j)) for j in near[e < -0.5]}
    turn = {m: [(i, i + m) in bond for i in range(k)] for m in (3, 4, 5)}

    def helix(m: int, mark: str, over: tuple[str, ...]) -> None:
        for i in range(k - m - 1):
            if turn[m][i] and turn[m][i + 1]:
                for j in range(i + 1, min(i + m + 1, k)):
                    if out[j] in over:
                        out[j] = mark

    helix(4, "H", ("C", "H"))
    helix(3, "G", ("C",))
    helix(5, "I", ("C",))
    bridged = set()
    for a, b in bond:
        for i, j in ((a + 1, b), (b, a + 1), (a, b), (b, a), (a + 1, b - 1), (b - 1, a + 1)):
            if not (1 <= i < k - 1 and i + 2 <= j < k - 1):
                continue
            parallel = (i - 1, j) in bond and (j, i + 1) in bond
            opposite = ((i, j) in bond and (j, i) in bond) or ((i - 1, j + 1) in bond and (j - 1, i + 1) in bond)
            if parallel or opposite:
                bridged |= {i, j}
    for i in bridged:
        if out[i] == "C":
            out[i] = "E"
    alone = [i for i in range(1, k - 1) if out[i] == "C" and out[i - 1] == out[i + 1] == "E"]
    for i in alone:
        out[i] = "E"
    for m in (4, 3, 5):
        for i in range(k):
            if turn[m][i]:
                for j in range(i, min(i + m, k)):
                    if out[j] == "C":
                        out[j] = "T"
    for mark, least in (("H", 3), ("E", 2)):
        i = 0
        while i < k:
            j = i
            while j < k and out[j] == mark:
                j += 1
            if 0 < j - i < least:
                out[i:j] = ["C"] * (j - i)
            i = max(j, i + 1)
    return out


def secondary_structure(atoms: DataFrame) -> DataFrame:
    """(mol_id, chain_id, res_seq, ss_type) by hydrogen bonds of the backbone; a group is one chain, which a kernel reads as a whole."""
    b = backbone(atoms)
    kind = dict(atoms.dtypes)["mol_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("res_seq")
        xyz = {a: np.array([[np.nan] * 3 if v is None else [v["x"], v["y"], v["z"]] for v in pdf[a]], float).reshape(-1, 3) for a in ("N", "CA", "C", "O")}
        return pd.DataFrame({"mol_id": pdf["mol_id"], "chain_id": pdf["chain_id"], "res_seq": pdf["res_seq"], "ss_type": assign_structure(xyz["N"], xyz["CA"], xyz["C"], xyz["O"])})

    return b.groupBy("mol_id", "chain_id").applyInPandas(run, f"mol_id {kind}, chain_id string, res_seq int, ss_type string")


def without_short_runs(df: DataFrame, key: str, order: str, value: str, marks: dict[str, int], other: str) -> DataFrame:
    """df in which runs of a value of `marks` shorter than its number are `other`; runs follow the order within a key."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.coalesce(F.lag(value).over(w) != F.col(value), F.lit(True)).cast("int")
    r = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("_length", F.count("*").over(Window.partitionBy(key, "_run")))
    out = F.col(value)
    for mark, least in marks.items():
        out = F.when((F.col(value) == mark) & (F.col("_length") < least), other).otherwise(out)
    return r.withColumn(value, out).drop("_new", "_run", "_length")


def alpha_carbons(atoms: DataFrame) -> DataFrame:
    """(mol_id, chain_id, res_seq, serial, letter): the first alpha carbon of each residue; X for a residue that is none of the twenty."""
    table = F.create_map(*[F.lit(x) for kv in ONE_LETTER.items() for x in kv])
    a = atoms.where("pdb_name = 'CA' and x is not null").groupBy("mol_id", "chain_id", "res_seq").agg(F.min(F.struct("serial", "res_name")).alias("a"))
    return a.select("mol_id", "chain_id", "res_seq", "a.serial", F.coalesce(F.try_element_at(table, F.upper("a.res_name")), F.lit("X")).alias("letter"))


def pairs_by_sequence(a: DataFrame, b: DataFrame, **scoring: float) -> DataFrame:
    """(mol_id, serial, r_serial): alpha carbons of both sides paired by the alignment of their sequences with affine gaps; a group is one molecule on both sides."""
    kind = dict(a.dtypes)["mol_id"]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        from crucible.chem.geometry import global_align

        left, right = (x.sort_values(["chain_id", "res_seq", "serial"]) for x in (left, right))
        if not len(left) or not len(right):
            return pd.DataFrame({"mol_id": [], "serial": [], "r_serial": []})
        pairs = global_align("".join(left["letter"]), "".join(right["letter"]), **scoring)[1]
        return pd.DataFrame({"mol_id": [left["mol_id"].iloc[0]] * len(pairs), "serial": [left["serial"].iloc[i] for i, _ in pairs], "r_serial": [right["serial"].iloc[j] for _, j in pairs]})

    return alpha_carbons(a).groupBy("mol_id").cogroup(alpha_carbons(b).groupBy("mol_id")).applyInPandas(run, f"mol_id {kind}, serial int, r_serial int")


def selected(atoms: DataFrame, selection: str) -> DataFrame:
    """Atoms with coordinates of a selection: all, heavy, ca or backbone."""
    a = atoms.where("x is not null and y is not null and z is not null")
    if selection == "all":
        return a
    if selection == "heavy":
        return a.where("symbol <> 'H'")
    if selection == "ca":
        return a.where("pdb_name = 'CA'")
    if selection == "backbone":
        return a.where("pdb_name in ('N', 'CA', 'C', 'O')")
    raise ValueError(f"unknown selection {selection}")


def contact_residues(ligand: DataFrame, receptor: DataFrame, distance: float = 5.0) -> DataFrame:
    """(mol_id, chain_id, res_seq): residues of the receptor with an atom within the distance of a ligand atom of the same molecule; a semi join on grid cells."""
    r = receptor.select("mol_id", "chain_id", "res_seq", *XYZ)
    return range_join(r, ligand.select("mol_id", *XYZ), distance, ["mol_id"], list(XYZ), "left_semi").select("mol_id", "chain_id", "res_seq").distinct()


def ranked_ligands(fragments: DataFrame) -> DataFrame:
    """(mol_id, fragment, size, score, rank): fragments of atoms (mol_id, fragment, is_hetatm, res_name) by the share of hetero atoms times 100, and 50 more from 6 to 99 atoms; waters are left out.

    Equal scores stand in the order of the fragment.
    """
    g = fragments.groupBy("mol_id", "fragment").agg(F.count("*").alias("size"), F.avg(F.col("is_hetatm").cast("int")).alias("het"), F.max(F.upper("res_name").isin("HOH", "WAT", "SOL", "DOD")).alias("water"))
    score = F.col("het") * 100 + F.when((F.col("size") > 5) & (F.col("size") < 100), 50).otherwise(0)
    g = g.where(~F.coalesce("water", F.lit(False))).select("mol_id", "fragment", "size", score.alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("mol_id").orderBy(F.desc("score"), "fragment")))


def radial_histogram(atoms: DataFrame, width: float = 0.1) -> DataFrame:
    """(mol_id, bin, symbol, n): atoms by their distance from the centre of mass over the radius of gyration, in bins of that width.

    Two aggregations by molecule; a molecule of no extent has all atoms in bin 0.
    """
    from crucible.chem.elements import MASS

    m = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MASS.items() for x in kv]), F.col("symbol")), F.lit(0.0))
    a = atoms.where("x is not null and y is not null and z is not null").withColumn("m", m)
    com = a.groupBy("mol_id").agg(F.sum("m").alias("mm"), *[(F.sum(F.col("m") * F.col(c)) / F.sum("m")).alias(f"c{c}") for c in XYZ])
    a = a.join(com, "mol_id").withColumn("r2", sum((F.pow(F.col(c) - F.col(f"c{c}"), 2) for c in XYZ), F.lit(0.0)))
    rg = a.groupBy("mol_id").agg(F.sqrt(F.sum(F.col("m") * F.col("r2")) / F.sum("m")).alias("rg"))
    b = F.when(F.col("rg") > 1e-12, F.floor(F.sqrt("r2") / F.col("rg") / width)).otherwise(0).cast("int")
    return a.join(rg, "mol_id").groupBy("mol_id", b.alias("bin"), "symbol").agg(F.count("*").alias("n"))


def merged_histogram(histograms: DataFrame) -> DataFrame:
    """(bin, symbol, mean): counts of all molecules over the number of molecules, with rows of 0 for bins up to the last that an element lacks."""
    h = histograms.groupBy("bin", "symbol").agg(F.sum("n").alias("n"))
    total = histograms.select("mol_id").distinct().count()
    last = h.agg(F.coalesce(F.max("bin"), F.lit(-1))).first()[0]
    every = h.select("symbol").distinct().select("symbol", F.explode(F.sequence(F.lit(0), F.lit(max(0, last)))).alias("bin"))
    return every.join(h, ["bin", "symbol"], "left").select("bin", "symbol", (F.coalesce("n", F.lit(0)) / F.lit(max(1, total))).alias("mean"))


def centres_of_mass(atoms: DataFrame) -> DataFrame:
    """(mol_id, mass, x, y, z); atoms without coordinates don't count."""
    from crucible.chem.elements import MASS

    m = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MASS.items() for x in kv]), F.col("symbol")), F.lit(0.0))
    a = atoms.where("x is not null and y is not null and z is not null").withColumn("m", m)
    return a.groupBy("mol_id").agg(F.sum("m").alias("mass"), *[F.try_divide(F.sum(F.col("m") * F.col(c)), F.sum("m")).alias(c) for c in XYZ])
