"""Operators on atoms with coordinates and on graphs of them: per-molecule kernels and contacts by range joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crucible.operators.joins import range_join

XYZ = ["x", "y", "z"]
SHAPES = (
    "RadiusOfGyration", "MassWeightedRadiusOfGyration", "Asphericity", "Eccentricity", "PrincipalMoment1", "PrincipalMoment2", "PrincipalMoment3", "InertiaMomentA", "InertiaMomentB", "InertiaMomentC", "NPR1", "NPR2", "InertialShapeFactor", "SpherocityIndex", "MolecularLength", "MolecularWidth",
    "MolecularThickness", "LengthToWidthRatio", "BoundingBoxVolume", "Span", "MolecularDiameter", "MeanAtomicDistance3D", "GeometricWienerIndex", "GravitationalIndex", "PlaneOfBestFit",
)


def shape_descriptors(atoms: DataFrame) -> DataFrame:
    """(mol_id, 25 descriptors) of atoms (mol_id, idx, symbol, x, y, z); a group is one molecule."""
    from crucible.chem.geometry import shape

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = shape(pdf[XYZ].to_numpy(float), pdf["symbol"].tolist())
        return pd.DataFrame([[pdf["mol_id"].iloc[0], *(v[n] for n in SHAPES)]], columns=["mol_id", *SHAPES])

    a = atoms.where("x is not null and y is not null and z is not null")
    return a.select("mol_id", "symbol", *XYZ).groupBy("mol_id").applyInPandas(run, f"mol_id {dict(atoms.dtypes)['mol_id']}, " + ", ".join(f"{n} double" for n in SHAPES))


def atom_surfaces(atoms: DataFrame, probe: float = 1.4, points: int = 256) -> DataFrame:
    """(mol_id, idx, sasa) of every atom with coordinates."""
    from crucible.chem.geometry import surface

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mol_id": pdf["mol_id"], "idx": pdf["idx"], "sasa": surface(pdf[XYZ].to_numpy(float), pdf["symbol"].tolist(), probe, points)})

    a = atoms.where("x is not null and y is not null and z is not null").select("mol_id", "idx", "symbol", *XYZ)
    return a.groupBy("mol_id").applyInPandas(run, f"mol_id {dict(atoms.dtypes)['mol_id']}, idx int, sasa double")


def align_to(mobile: DataFrame, reference: DataFrame, cycles: int = 0) -> DataFrame:
    """(mol_id, rmsd, pairs) of every molecule against its reference, atoms paired by idx; fewer than three pairs give null.

    Both sides hold (mol_id, idx, x, y, z). cycles > 0 drops outlying pairs.
    """
    from crucible.chem.geometry import kabsch, superpose

    j = mobile.select("mol_id", "idx", *XYZ).join(reference.select("mol_id", "idx", *[F.col(c).alias(f"r{c}") for c in XYZ]), ["mol_id", "idx"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[XYZ].to_numpy(float), pdf[["rx", "ry", "rz"]].to_numpy(float)
        rmsd, n = None, len(a)
        if n >= 3:
            rmsd, n = superpose(a, b, cycles)[2:] if cycles else (kabsch(a, b)[2], n)
        return pd.DataFrame({"mol_id": [pdf["mol_id"].iloc[0]], "rmsd": [rmsd], "pairs": [n]})

    return j.dropna(subset=[*XYZ, "rx", "ry", "rz"]).groupBy("mol_id").applyInPandas(run, f"mol_id {dict(mobile.dtypes)['mol_id']}, rmsd double, pairs int")


def contacts(ligand: DataFrame, receptor: DataFrame) -> DataFrame:
    """(mol_id, idx, r_idx, kind, dist): hydrogen bonds (N, O, 2.5 to 3.6 Å), salt bridges (opposite charges, 4.5 Å) and hydrophobic contacts (C, 4.5 Å)."""
    cols = ["mol_id", "idx", "symbol", "formal_charge", *XYZ]
    near = range_join(ligand.select(*cols), receptor.select(*cols), 4.5, ["mol_id"], XYZ)
    polar = lambda p: F.col(f"{p}symbol").isin("N", "O")
    kinds = F.array_compact(F.array(
        F.when(polar("") & polar("r_") & F.col("dist").between(2.5, 3.6), "hydrogen bond"),
        F.when(F.col("formal_charge") * F.col("r_formal_charge") < 0, "salt bridge"),
        F.when((F.col("symbol") == "C") & (F.col("r_symbol") == "C"), "hydrophobic"),
    ))
    return near.select("mol_id", "idx", "r_idx", F.explode(kinds).alias("kind"), "dist")


def auto_bonds(atoms: DataFrame, slack: float = 0.45) -> DataFrame:
    """(mol_id, a, b, dist): atoms closer than their covalent radii and the slack, but not on one spot; a < b."""
    from crucible.chem.elements import elements

    r = F.create_map(*[v for k, e in elements().items() for v in (F.lit(k), F.lit(e.covalent_radius))])
    a = atoms.select("mol_id", "idx", F.coalesce(F.try_element_at(r, F.col("symbol")), F.lit(0.76)).alias("radius"), *XYZ)
    j = range_join(a, a, 4.0, ["mol_id"], XYZ).where((F.col("idx") < F.col("r_idx")) & (F.col("dist") > 0.4) & (F.col("dist") < F.col("radius") + F.col("r_radius") + slack))
    return j.select("mol_id", F.col("idx").alias("a"), F.col("r_idx").alias("b"), "dist")


def dbscan(points: DataFrame, id_col: str, coords: list[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """(id, cluster): density clusters by a range join and connected components of core points; -1 for noise.

    A point has itself as a neighbour; a border point joins its smallest core neighbour's cluster.
    """
    from crucible.operators.components import connected_components
    from crucible.runtime import cut

    p = points.select(F.col(id_col).alias("i"), *coords).withColumn("one", F.lit(1))
    near = cut(range_join(p, p, eps, ["one"], coords).select("i", F.col("r_i").alias("j")))
    core = near.groupBy("i").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("i")
    links = near.join(core, "i", "left_semi").join(core.withColumnRenamed("i", "j"), "j", "left_semi")
    cc = connected_components(links, "i", "j")
    core = core.join(cc, core.i == cc.node, "left").select("i", F.coalesce("component", "i").alias("cluster"))
    border = near.join(core.toDF("j", "cluster"), "j").groupBy("i").agg(F.min_by("cluster", "j").alias("near_cluster"))
    out = points.select(F.col(id_col).alias("i")).join(core, "i", "left").join(border, "i", "left")
    return out.select(F.col("i").alias(id_col), F.coalesce("cluster", "near_cluster", F.lit(-1)).alias("cluster"))


def smooth_knn(neighbours: DataFrame, k: int, rounds: int = 64) -> DataFrame:
    """(i, j, w): directed fuzzy weights exp(-(d - rho) / sigma) of (query, id, distance) rows; sigma by bisection so that they sum to log2 k.

    rho is the least distance above 0. A row's neighbours come as one list of k; a batch of rows is bisected at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = b["d"].map(len).to_numpy() if len(b) else np.zeros(0, int)
            if not len(n):
                continue
            d = np.full((len(n), n.max()), np.inf)
            there = np.arange(n.max())[None, :] < n[:, None]
            d[there] = np.concatenate([np.asarray(x, float) for x in b["d"]])
            rho = np.where(there & (d > 0), d, np.inf).min(axis=1)
            rho = np.where(np.isfinite(rho), rho, 0.0)
            over = np.where(there, np.maximum(d - rho[:, None], 0), np.inf)
            lo, hi, sigma, target = np.zeros(len(n)), np.full(len(n), np.inf), np.ones(len(n)), np.log2(k)
            live = np.ones(len(n), bool)
            for _ in range(rounds):
                s = np.exp(-over / sigma[:, None]).sum(axis=1)
                live &= np.abs(s - target) >= 1e-5
                high = live & (s > target)
                low = live & ~high
                hi = np.where(high, sigma, hi)
                lo = np.where(low, sigma, lo)
                sigma = np.where(high, (lo + hi) / 2, np.where(low, np.where(np.isfinite(hi), (sigma + np.where(np.isfinite(hi), hi, 0)) / 2, sigma * 2), sigma))
            mean = np.where(there, d, 0).sum(axis=1) / np.maximum(n, 1)
            sigma = np.maximum(sigma, 1e-3 * np.where(mean > 0, mean, 1.0))
            yield pd.DataFrame({"i": np.repeat(b["query"].to_numpy(), n), "j": np.concatenate([np.asarray(x) for x in b["ids"]]), "w": np.exp(-over / sigma[:, None])[there]})

    listed = neighbours.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("l"))  # k entries a row
    return listed.select("query", F.col("l")["distance"].alias("d"), F.col("l")["id"].alias("ids")).mapInPandas(run, "i long, j long, w double")
