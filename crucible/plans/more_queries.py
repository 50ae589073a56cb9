"""Queries of splits, statistics, proteins, contacts, descriptors of charge and surface, and maps, with their SQL.

Points of a protein's backbone are the numbers of an embedding taken in threes: residue r has N, CA, C at the points 3r, 3r + 1, 3r + 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crucible.functions import molecules as M
from crucible.operators import dataset as D
from crucible.operators import embedding as E
from crucible.operators import models as Q
from crucible.operators import residues as R
from crucible.operators import similarity as S
from crucible.operators import statistics as T
from crucible.operators import structure as G
from crucible.plans.molecule_queries import _made
from crucible.runtime import spread, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))


def _chain_atoms(spark: SparkSession, d: str) -> DataFrame:
    """Backbone atoms of seven residues an embedding, coordinates ten times its numbers; the fourth residue's number skips one."""
    e = table(spark, d, "embeddings")
    p = e.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("p"), "embedding")
    at = lambda k: (F.get("embedding", F.col("p") * 3 + k).cast("double") * 10)
    r = F.floor(F.col("p") / 3).cast("int")
    name = F.element_at(F.array(F.lit("N"), F.lit("CA"), F.lit("C")), (F.col("p") % 3 + 1).cast("int"))
    res = F.element_at(F.array(F.lit("ALA"), F.lit("GLY"), F.lit("TRP"), F.lit("UNK")), (F.pmod(F.col("vec_id") + r, F.lit(4)) + 1).cast("int"))
    return p.select(F.col("vec_id").alias("mol_id"), F.lit("A").alias("chain_id"), (r + (r >= 3).cast("int")).alias("res_seq"), res.alias("res_name"), name.alias("pdb_name"), F.col("p").alias("serial"), at(0).alias("x"), at(1).alias("y"), at(2).alias("z"))


def backbone_torsions(spark: SparkSession, d: str) -> DataFrame:
    t = R.torsions(_chain_atoms(spark, d))
    return t.select("mol_id", "res_seq", *[F.round(f(F.radians(c)), 4).alias(f"{n}_{c}") for c in ("phi", "psi") for n, f in (("cos", F.cos), ("sin", F.sin))])


def torsion_regions(spark: SparkSession, d: str) -> DataFrame:
    """Residues by region of their torsions."""
    t = R.torsions(_chain_atoms(spark, d)).select("mol_id", F.when(F.col("phi").isNotNull() & F.col("psi").isNotNull(), "placed").otherwise("end").alias("kind"), R.region().alias("region"))
    return t.groupBy("kind").agg(F.count("*").alias("n"), F.count("region").alias("named"))


def backbone_bonds(spark: SparkSession, d: str) -> DataFrame:
    return R.peptide_bonds(_chain_atoms(spark, d)).select("mol_id", "res_seq", F.round("length", 5).alias("length"))


def residue_letters(spark: SparkSession, d: str) -> DataFrame:
    return R.alpha_carbons(_chain_atoms(spark, d)).select("mol_id", "res_seq", "serial", "letter")


def residue_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every chain aligned with itself: its own alpha carbons."""
    a = _chain_atoms(spark, d)
    return R.pairs_by_sequence(a, a)


def secondary_structures(spark: SparkSession, d: str) -> DataFrame:
    """Chains without oxygens have no hydrogen bonds: all coil."""
    a = _chain_atoms(spark, d)
    return R.secondary_structure(a).groupBy("mol_id").agg(F.count("*").alias("n"), F.count_if(F.col("ss_type") == "C").alias("coil"))


def selected_atoms(spark: SparkSession, d: str) -> DataFrame:
    a = _chain_atoms(spark, d).withColumn("symbol", F.substring("pdb_name", 1, 1))
    out = None
    for kind in ("all", "heavy", "ca", "backbone"):
        x = R.selected(a, kind).groupBy("mol_id").agg(F.count("*").alias("n")).withColumn("selection", F.lit(kind))
        out = x if out is None else out.union(x)
    return out


def contact_residues(spark: SparkSession, d: str) -> DataFrame:
    """Residues with an atom within 2 of the first residue's atoms."""
    a = _chain_atoms(spark, d)
    return R.contact_residues(a.where("res_seq = 0"), a.where("res_seq > 0"), 2.0).select("mol_id", "res_seq")


def polar_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contacts between nitrogens of opposite formal charges and carbons of the backbone points, by kind."""
    a = _chain_atoms(spark, d).select("mol_id", F.col("serial").alias("idx"), F.substring("pdb_name", 1, 1).alias("symbol"), F.when(F.col("pdb_name") == "N", F.when(F.col("res_seq") % 2 == 0, 1).otherwise(-1)).otherwise(0).alias("formal_charge"), "x", "y", "z")
    c = G.contacts(a, a).where("idx < r_idx")
    return c.groupBy("mol_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("dist"), 4).alias("total"))


def auto_bonded(spark: SparkSession, d: str) -> DataFrame:
    a = _chain_atoms(spark, d).select("mol_id", F.col("serial").cast("int").alias("idx"), F.substring("pdb_name", 1, 1).alias("symbol"), "x", "y", "z")
    return G.auto_bonds(a).select("mol_id", "a", "b", F.round("dist", 5).alias("dist"))


def mass_centres(spark: SparkSession, d: str) -> DataFrame:
    a = _chain_atoms(spark, d).withColumn("symbol", F.substring("pdb_name", 1, 1))
    return R.centres_of_mass(a).select("mol_id", F.round("mass", 3).alias("mass"), *[F.round(c, 5).alias(c) for c in "xyz"])


def radial_bins(spark: SparkSession, d: str) -> DataFrame:
    a = _chain_atoms(spark, d).withColumn("symbol", F.substring("pdb_name", 1, 1))
    return R.radial_histogram(a, 0.5).groupBy("mol_id", "symbol").agg(F.sum("n").alias("n"), F.max("bin").alias("last"))


def radial_mean(spark: SparkSession, d: str) -> DataFrame:
    a = _chain_atoms(spark, d).withColumn("symbol", F.substring("pdb_name", 1, 1))
    return R.merged_histogram(R.radial_histogram(a, 0.5)).groupBy("symbol").agg(F.round(F.sum("mean"), 6).alias("atoms"))


def ligand_ranks(spark: SparkSession, d: str) -> DataFrame:
    """Orders as molecules, suppliers as fragments: lines returned are hetero atoms."""
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("mol_id"), (F.col("l_suppkey") % 3).alias("fragment"), (F.col("l_returnflag") == "R").alias("is_hetatm"), F.when(F.col("l_suppkey") % 3 == 2, "HOH").otherwise("LIG").alias("res_name"))
    return R.ranked_ligands(f).select("mol_id", "fragment", "size", F.round("score", 6).alias("score"), "rank")


def short_runs(spark: SparkSession, d: str) -> DataFrame:
    """Single clicks and runs of purchases under two become views."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    r = R.without_short_runs(e, "user_id", "at", "event_type", {"click": 2, "purchase": 2}, "other")
    return r.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


def atom_summary(spark: SparkSession, d: str) -> DataFrame:
    """Donors, acceptors, lipophilic and polar atoms of the alcohols."""
    from crucible.operators.selection import Selector
    from crucible.runtime import written

    m = written(M.molecules(_made(spark, d, "alcohol"), "mol_id", "smiles"))
    return Selector(M.atoms(m), M.bonds(m), M.rings(m)).summary()


# --- datasets and statistics ----------------------------------------------------


def random_shares(spark: SparkSession, d: str) -> DataFrame:
    """Exactly int(n * 0.8) rows are Train, those of smallest hash."""
    r = D.random_split(table(spark, d, "compounds"), "record_id", 0.8)
    h = F.xxhash64("record_id", F.lit(42))
    return r.agg(F.count_if(F.col("split_status") == "Train").alias("train"), F.count_if(F.col("split_status") == "Test").alias("test"), (F.max(F.when(F.col("split_status") == "Train", h)) <= F.min(F.when(F.col("split_status") == "Test", h))).alias("in_order"))


def packed_brands(spark: SparkSession, d: str) -> DataFrame:
    """Brands by size, packed whole."""
    return D.group_packing(table(spark, d, "part"), "p_brand", 0.8).select("p_partkey", "split_status")


def scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    """Rings with a tail: sizes up to 20 are scaffolds, others are groups of their own."""
    r = _made(spark, d, "ring").select("mol_id", "n", F.concat(F.lit("OC"), "smiles").alias("smiles"))
    s = D.scaffold_split(r, "smiles", "mol_id", 0.8)
    return s.groupBy("n").agg(F.count_distinct("scaffold").alias("groups"), F.count_distinct("split_status").alias("sides"), F.count("*").alias("rows")).where("n <= 20")


def compound_scaffold_split(spark: SparkSession, d: str) -> DataFrame:
    """Real compounds by their scaffolds: no group on both sides, and the shares."""
    c = D.cleanse(table(spark, d, "compounds").select("record_id", "smiles"), "smiles", "record_id")
    s = D.scaffold_split(c, "smiles", "record_id", 0.8)
    g = s.groupBy("scaffold").agg(F.count("*").alias("n"), F.count_distinct("split_status").alias("sides"), F.count_if(F.col("split_status") == "Train").alias("train"))
    return g.agg(F.sum("n").alias("n"), F.max("sides").alias("sides"), (F.abs(F.sum("train") - F.floor(F.sum("n") * 0.8)) <= F.max("n")).alias("near"))


def split_engine(spark: SparkSession, d: str) -> DataFrame:
    """Splits by name of the compounds with their columns as features: rows of each side."""
    c = table(spark, d, "compounds").select("record_id", "smiles", "target", *[F.nullif(F.col(f"descriptor_{k}"), F.lit(-999.0)).alias(f"descriptor_{k}") for k in (1, 2, 3)])
    out = None
    for name in ("Random", "Kennard-Stone", "D-Optimal", "Duplex"):
        x = D.split_dataset(c, name, 0.8, "smiles", "record_id", feature_cols=["descriptor_1", "descriptor_2", "descriptor_3"])
        x = x.groupBy("split_status").agg(F.count("*").alias("n")).withColumn("algorithm", F.lit(name))
        out = x if out is None else out.union(x)
    return out


def boruta_split(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "compounds").where("target is not null").select("record_id", "smiles", "target", *[F.nullif(F.col(f"descriptor_{k}"), F.lit(-999.0)).alias(f"descriptor_{k}") for k in (1, 2, 3)])
    return D.split_dataset(c, "Boruta", 0.8, "smiles", "record_id", "target", ["descriptor_1", "descriptor_2", "descriptor_3"]).groupBy("split_status").agg(F.count("*").alias("n"))


def side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """Customers and parts row by row in the order of their keys."""
    c, p = table(spark, d, "customer").select("c_custkey"), table(spark, d, "part").select("p_partkey", "p_size")
    return D.concat_columns([c, p], ["c_custkey", "p_partkey"])


def pruned_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bits of the order of keys kept by frequency; equal ones once."""
    x = table(spark, d, "customer").select(F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.when(F.pmod(F.col("c_custkey"), i % 8 + 2) == 0, i)), lambda v: v.isNotNull()).alias("bits"))
    return D.prune_bits(x, "bits", 16, max_frequency=0.4).select("bit", F.round("frequency", 8).alias("frequency"))


def percent_of_splits(spark: SparkSession, d: str) -> DataFrame:
    r = D.split_statistics(table(spark, d, "compounds").withColumn("s", F.lower(F.trim("split"))), "s", "target")
    return r.select("s", "n", F.round("pct", 6).alias("pct"))


def target_ks(spark: SparkSession, d: str) -> DataFrame:
    """How the target's distribution in each split differs from train's."""
    c = table(spark, d, "compounds").where("target <> -999").select(F.lower(F.trim("split")).alias("s"), "target")
    return T.kolmogorov_smirnov(c, "s", "target", "train").select("s", F.round("ks", 8).alias("ks"))


def residuals(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    return T.standardised_residuals(x, "y", "p").select("l_orderkey", "l_linenumber", F.round("std_residual", 6).alias("r"))


def external_tests(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    r = T.external_criteria(x, "y", "p")
    return r.select(*[F.round(c, 6).alias(c) for c in ("r2", "k", "k_prime", "r2_zero_diff")], "passed")


def fit_scores(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted determination and lack of fit of a prediction with three features."""
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    m = x.agg(F.pow(F.corr("y", "p"), 2).alias("r2"), F.count("*").alias("n"), F.sum(F.pow(F.col("y") - F.col("p"), 2)).alias("sse"))
    return m.select(F.round(T.adjusted_r2(F.col("r2"), F.col("n"), 3), 8).alias("adjusted"), F.round(T.lack_of_fit(F.col("sse"), F.col("n"), 3), 2).alias("lof"))


def domain(spark: SparkSession, d: str) -> DataFrame:
    """Leverages with intercept of one feature, by the training rows."""
    c = table(spark, d, "compounds").where("target <> -999 and descriptor_1 <> -999").select("record_id", F.array("descriptor_1").alias("x"), "target", (F.col("target") * 0).alias("p"), (F.lower(F.trim("split")) == "train").alias("tr"))
    r = T.applicability_domain(c, "record_id", "x", "target", "p", F.coalesce("tr", F.lit(False)))
    return r.select("record_id", F.round("leverage", 8).alias("leverage"), F.round("std_residual", 6).alias("std_residual"), "inside")


def multiclass(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("y"), F.when(F.col("l_quantity") > 33, "A").when(F.col("l_linestatus") == "O", "N").otherwise("R").alias("p"))
    r = T.class_metrics(x, "y", "p")
    return r.select(*[F.round(c, 8).alias(c) for c in r.columns])


def precision_area(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_quantity").alias("s"))
    return T.average_precision(x, "y", "s").select(F.round("pr_auc", 8).alias("pr_auc"))


def class_sizes(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = T.check_classes(li, "l_returnflag", "Ternary")
    return T.class_counts(li, "l_returnflag").withColumn("checked", F.lit(n))


def score_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Scores from decision values of two and of three classes."""
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 10 - 2).alias("v"), F.array(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.5)).alias("vs"))
    return x.select("l_orderkey", "l_linenumber", F.round(T.class_scores(F.col("v"), 2)[1], 8).alias("two"), F.round(T.class_scores(F.col("vs"), 3)[0], 8).alias("three"))


# --- similarity, charges, maps -----------------------------------------------------


def _signs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: (v > 0).cast("double")).alias("x"))


def tanimoto_knn(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest(_signs(spark, d), "id", "x", 5, "tanimoto").select("query", "id", "rank", F.round("distance", 8).alias("distance"))


def dice_knn(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest(_signs(spark, d), "id", "x", 5, "dice").select("query", "id", "rank", F.round("distance", 8).alias("distance"))


def hamming_knn(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest(_signs(spark, d), "id", "x", 5, "hamming").select("query", "id", "rank", F.round("distance", 8).alias("distance"))


def bit_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Tanimoto of the sets of positive places of every hundredth embedding and all others, above 0.45."""
    e = table(spark, d, "embeddings").select("vec_id", F.filter(F.transform("embedding", lambda v, i: F.when(v > 0, i)), lambda v: v.isNotNull()).alias("bits"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("bits").alias("b"))
    # the stated query set against all rows: every set is met by the bits it shares
    j = e.select("vec_id", "bits", F.explode("bits").alias("bit")).join(q.select("query", "b", F.explode("b").alias("bit")), "bit").where("vec_id <> query")
    p = j.groupBy("query", "vec_id").agg(F.count("*").alias("c"), F.first(F.size("bits")).alias("m"), F.first(F.size("b")).alias("n"))
    s = F.col("c") / (F.col("m") + F.col("n") - F.col("c"))
    return p.select("query", "vec_id", F.round(s, 8).alias("similarity")).where("similarity > 0.45")


def alcohol_charges(spark: SparkSession, d: str) -> DataFrame:
    """Charges of the alcohols sum to zero; the oxygen has the least, as far as the first carbon's is the highest."""
    names = ["TotalCharge", "MinPartialCharge", "MaxPartialCharge", "PolarAtomCharge"]
    x = M.descriptor_table(_made(spark, d, "alcohol").where("n > 1"), "mol_id", "smiles", names)
    return x.select("mol_id", F.round("TotalCharge", 3).alias("total"), F.round("MinPartialCharge", 4).alias("least"), F.round("PolarAtomCharge", 4).alias("polar"))


def polar_surface(spark: SparkSession, d: str) -> DataFrame:
    names = ["TPSA", "TPSAWithSP", "MolarRefractivity", "VeberViolations", "SyntheticAccessibility", "LongestChain", "HydrophilicFactor"]
    x = M.descriptor_table(_made(spark, d, "alcohol").where("n > 1"), "mol_id", "smiles", names)
    return x.select("mol_id", *[F.round(n, 6).alias(n.lower()) for n in names])


def charge_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Charges of the real molecules add up to their formal charge."""
    from crucible.chem.descriptors import names

    m = spread(table(spark, d, "molecules").where("error is null and smiles is not null"))
    x = M.descriptor_table(m, "mol_id", "smiles", [*names(("charges",)), "FormalCharge"])
    return x.select("mol_id", (F.abs(F.col("TotalCharge") - F.col("FormalCharge")) < 0.02).alias("kept"), ((F.col("MaxPartialCharge") - F.col("MinPartialCharge") - F.col("SubmolecularPolarity")) < 1e-9).alias("span"))


def space_descriptors(spark: SparkSession, d: str) -> DataFrame:
    """Shape and surface of the embedded structures: relations that always hold."""
    from crucible.chem.descriptors import names

    s = spread(table(spark, d, "structures").where("smiles is not null"))
    x = M.descriptor_table(s, "id", "smiles", names(("space",)))
    close = lambda a, b: F.abs(a - b) <= 1e-6 * F.greatest(F.abs(a), F.lit(1.0))
    c = F.col
    return x.select("id", close(c("PolarSurfaceArea") + c("APolarSurfaceArea"), c("SASA")).alias("areas"), close(c("DPSA1"), c("PPSA1") - c("PNSA1")).alias("differences"), (c("PrincipalMoment1") >= c("PrincipalMoment3") - 1e-9).alias("moments"), (c("Globularity") <= 1.5).alias("round"))


def umap_map(spark: SparkSession, d: str) -> DataFrame:
    """A map of all embeddings: rows, and whether all places are numbers."""
    m = E.fit_umap(_vectors(spark, d), "id", "x", epochs=40)
    return m.embedding.agg(F.count("*").alias("n"), F.min(F.size("y")).alias("dims"), F.count_if(F.exists("y", lambda v: F.isnan(v))).alias("missing"))


def umap_placed(spark: SparkSession, d: str) -> DataFrame:
    """Shifted copies placed in the map of the originals."""
    v = _vectors(spark, d)
    m = E.fit_umap(v, "id", "x", epochs=40)
    new = v.select((F.col("id") + 1_000_000).alias("id"), F.transform("x", lambda t: t + 0.001).alias("x"))
    return E.transform_umap(m, new, "id", "x").agg(F.count("*").alias("n"), F.count_if(F.exists("y", lambda v: F.isnan(v))).alias("missing"))


def fuzzy_weights(spark: SparkSession, d: str) -> DataFrame:
    """The neighbour graph of all embeddings: symmetric, its largest weight 1, every row in it."""
    g = E.fuzzy_graph(_vectors(spark, d), "id", "x", 10)
    r = g.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("v"))
    j = g.join(r, ["i", "j"], "left")
    return j.agg(F.count_distinct("i").alias("rows"), F.round(F.max("w"), 9).alias("most"), F.count_if(F.coalesce(F.abs(F.col("w") - F.col("v")) > 1e-12, F.lit(True))).alias("lopsided"))


def curve_fit(spark: SparkSession, d: str) -> DataFrame:
    """The customary parameters of the map's curve."""
    return spark.createDataFrame([(s, m, *[round(v, 3) for v in E.curve_parameters(s, m)]) for s, m in ((1.0, 0.1), (1.0, 0.5))], "spread double, min_dist double, a double, b double")


def isolated(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings and one point far off: its score is the highest."""
    v = _vectors(spark, d)
    far = spark.createDataFrame([(-1, [9.0] * 64)], "id long, x array<double>")
    s = E.isolation_scores(v.union(far), "id", "x", trees=30)
    return s.agg(F.count("*").alias("n"), F.max_by("id", "score").alias("top"), F.count_if((F.col("score") <= 0) | (F.col("score") >= 1)).alias("outside"))


# --- models ------------------------------------------------------------------------

FEATURES = ["l_quantity", "l_discount", "l_tax"]


def loo_fit(spark: SparkSession, d: str) -> DataFrame:
    """Least squares of price on quantity, each row held out in turn."""
    r = Q.leave_one_out(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return r.select("n", F.round(F.sqrt(F.col("press") / F.col("n")), 3).alias("rmse"), F.round("q2", 7).alias("q2"))


def fold_fit(spark: SparkSession, d: str) -> DataFrame:
    """Folds by hash: rows, and whether the whole error lies between the folds' and beside the fit's own."""
    r = Q.cross_validate(table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")), "k", FEATURES, "l_extendedprice")
    all_ = r.where("fold = -1").select(F.col("rmse").alias("whole"), F.col("n").alias("total"))
    return r.where("fold >= 0").crossJoin(F.broadcast(all_)).agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.count("*").alias("folds"), ((F.min("rmse") <= F.max("whole")) & (F.max("whole") <= F.max("rmse"))).alias("inside"))


def pls_fit(spark: SparkSession, d: str) -> DataFrame:
    """Partial least squares with all components is least squares."""
    m = Q.Moments.by_fold(table(spark, d, "lineitem"), FEATURES, "l_extendedprice")[0]
    (w, b), (v, c) = m.pls(3), m.ridge()
    one = Q.Moments.by_fold(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")[0].pls(1)
    return spark.createDataFrame([(bool(abs(w - v).max() < 1e-6 * abs(v).max() and abs(b - c) < 1e-3), round(float(one[0][0]), 4), round(one[1], 3))], "same boolean, slope double, intercept double")


def genes(spark: SparkSession, d: str) -> DataFrame:
    """The genetic search over three features finds what all their subsets give."""
    return spark.createDataFrame([(c,) for c in Q.select_by_genes(table(spark, d, "lineitem"), FEATURES, "l_extendedprice", most=1)], "feature string")


def foxes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c,) for c in Q.select_by_foxes(table(spark, d, "lineitem"), FEATURES, "l_extendedprice", 1)], "feature string")


def chance_fits(spark: SparkSession, d: str) -> DataFrame:
    """Shuffled targets fit worse than the true ones."""
    li = table(spark, d, "lineitem").withColumn("k", F.concat_ws("-", "l_orderkey", "l_linenumber")).withColumn("made", F.col("l_quantity") * 3 + F.col("l_tax") * F.col("l_discount"))
    r = Q.shuffled_targets(li, "k", FEATURES, "made", 3)
    return r.agg(F.count("*").alias("trials"), (F.max(F.when(F.col("trial") > 0, F.col("r2"))) < F.max(F.when(F.col("trial") == 0, F.col("r2")))).alias("worse"))


def flag_classes(spark: SparkSession, d: str) -> DataFrame:
    """Return flags from quantities and taxes: both sets are judged."""
    li = table(spark, d, "lineitem").withColumn("s", F.when(F.col("l_orderkey") % 5 == 0, "test").otherwise("train"))
    r = Q.classification(li, ["l_quantity", "l_tax"], "l_returnflag", "s", "bayes", "Ternary")
    return r.select("set", F.col("accuracy").between(0, 1).alias("sane"))


def curated_molecules(spark: SparkSession, d: str) -> DataFrame:
    """Results by molecule whatever its writing: rows that count."""
    a = table(spark, d, "activities").where("standard_units = 'nM' and ic50 > 0")
    r = D.curate_molecules(spread(a), "smiles", "ic50", how="max", first_of=("source",), order_col="activity_id")
    return r.agg(F.max("value").alias("most"), F.count_if(F.col("n") < 1).alias("empty"))


def exclusion_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of atoms one, two and three bonds apart in the chains."""
    p = M.shortest_paths(_made(spark, d, "chain"), "mol_id", "smiles").where("d <= 3")
    return p.groupBy("mol_id", "d").agg(F.count("*").alias("n"))


def queries() -> dict:
    own = (
        loo_fit, fold_fit, pls_fit, genes, foxes, chance_fits, flag_classes, curated_molecules, exclusion_pairs,
        backbone_torsions, torsion_regions, backbone_bonds, residue_letters, residue_pairs, secondary_structures, selected_atoms, contact_residues, polar_contacts, auto_bonded, mass_centres, radial_bins, radial_mean, ligand_ranks, short_runs, atom_summary,
        random_shares, packed_brands, scaffold_split, compound_scaffold_split, split_engine, boruta_split, side_by_side, pruned_bits, percent_of_splits, target_ks, residuals, external_tests, fit_scores, domain, multiclass, precision_area, class_sizes, score_matrix,
        tanimoto_knn, dice_knn, hamming_knn, bit_similarity, alcohol_charges, polar_surface, charge_descriptors, space_descriptors, umap_map, umap_placed, fuzzy_weights, curve_fit, isolated,
    )
    return {f.__name__: f for f in own}


TYPES = {
    "exclusion_pairs": {"d": "INTEGER", "n": "BIGINT"},
    "residue_letters": {"res_seq": "INTEGER", "serial": "INTEGER"}, "residue_pairs": {"serial": "INTEGER", "r_serial": "INTEGER"}, "backbone_torsions": {"res_seq": "INTEGER"}, "backbone_bonds": {"res_seq": "INTEGER"}, "contact_residues": {"res_seq": "INTEGER"}, "auto_bonded": {"a": "INTEGER", "b": "INTEGER"},
    "radial_bins": {"last": "INTEGER"}, "ligand_ranks": {"rank": "INTEGER"}, "class_sizes": {"checked": "INTEGER"}, "tanimoto_knn": {"rank": "INTEGER"}, "dice_knn": {"rank": "INTEGER"}, "hamming_knn": {"rank": "INTEGER"}, "umap_map": {"dims": "INTEGER"}, "pruned_bits": {"bit": "INTEGER"},
    "side_by_side": {"place": "BIGINT"}, "torsion_regions": {"n": "BIGINT", "named": "BIGINT"}, "secondary_structures": {"n": "BIGINT", "coil": "BIGINT"}, "selected_atoms": {"n": "BIGINT"}, "mass_centres": {"mass": "DOUBLE"}, "atom_summary": dict.fromkeys(("atoms", "donors", "acceptors", "lipophilic", "polar", "heavy"), "BIGINT"),
    "scaffold_split": {"groups": "BIGINT", "sides": "BIGINT"}, "compound_scaffold_split": {"sides": "BIGINT"}, "polar_surface": dict.fromkeys(("tpsa", "tpsawithsp", "molarrefractivity", "veberviolations", "syntheticaccessibility"), "DOUBLE"),
}


def oracle_sql() -> dict[str, str]:
    pts = """pts AS (SELECT vec_id AS mol_id, p, embedding[3 * p + 1]::DOUBLE * 10 AS x, embedding[3 * p + 2]::DOUBLE * 10 AS y, embedding[3 * p + 3]::DOUBLE * 10 AS z, (p // 3 + CASE WHEN p // 3 >= 3 THEN 1 ELSE 0 END)::INT AS res_seq, ['N', 'CA', 'C'][p % 3 + 1] AS name,
        ['ALA', 'GLY', 'TRP', 'UNK'][(vec_id + p // 3) % 4 + 1] AS res_name, ['A', 'G', 'W', 'X'][(vec_id + p // 3) % 4 + 1] AS letter, ['N', 'C', 'C'][p % 3 + 1] AS symbol FROM embeddings, (SELECT unnest(range(21)) AS p))"""
    res = f"WITH {pts}, r AS (SELECT mol_id, res_seq, max(letter) AS letter, " + ", ".join(f"max(CASE WHEN name = '{n}' THEN {c} END) AS {n}_{c}" for n in ("N", "CA", "C") for c in "xyz") + " FROM pts GROUP BY 1, 2)"

    def angle(p: list[str]) -> tuple[str, str]:
        """Cosine and sine of the torsion of four points given by prefixes of x, y, z."""
        sub = lambda a, b: [f"({b}_{c} - {a}_{c})" for c in "xyz"]
        cross = lambda u, v: [f"({u[1]} * {v[2]} - {u[2]} * {v[1]})", f"({u[2]} * {v[0]} - {u[0]} * {v[2]})", f"({u[0]} * {v[1]} - {u[1]} * {v[0]})"]
        dot = lambda u, v: "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"
        b1, b2, b3 = sub(p[0], p[1]), sub(p[1], p[2]), sub(p[2], p[3])
        n1, n2 = cross(b1, b2), cross(b2, b3)
        a = f"atan2({dot(cross(n1, n2), b2)} / sqrt({dot(b2, b2)}), {dot(n1, n2)})"
        return f"round(cos({a}), 4)", f"round(sin({a}), 4)"

    joined = res + ", j AS (SELECT r.*, " + ", ".join(f"p.C_{c} AS P_{c}, q.N_{c} AS Q_{c}" for c in "xyz") + " FROM r LEFT JOIN r p ON p.mol_id = r.mol_id AND p.res_seq = r.res_seq - 1 LEFT JOIN r q ON q.mol_id = r.mol_id AND q.res_seq = r.res_seq + 1)"
    phi, psi = angle(["P", "N", "CA", "C"]), angle(["N", "CA", "C", "Q"])
    mass = "CASE symbol WHEN 'N' THEN 14.007 ELSE 12.011 END"
    gap = "sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)"
    com = f"WITH {pts}, c AS (SELECT mol_id, sum({mass}) AS mass, " + ", ".join(f"sum({mass} * {c}) / sum({mass}) AS {c}" for c in "xyz") + " FROM pts GROUP BY 1)"
    radial = f"{com}, d AS (SELECT p.mol_id, symbol, {mass} AS m, (p.x - c.x) ** 2 + (p.y - c.y) ** 2 + (p.z - c.z) ** 2 AS r2 FROM pts p JOIN c USING (mol_id)), g AS (SELECT mol_id, sqrt(sum(m * r2) / sum(m)) AS rg FROM d GROUP BY 1)"
    signs = "(SELECT vec_id, list_transform(embedding, lambda v: (v > 0)::INT) AS b FROM embeddings)"
    both = "list_sum(list_transform(list_zip(a.b, c.b), lambda t: t[1] * t[2]))"
    one, two = "list_sum(a.b)", "list_sum(c.b)"

    def knn(distance: str, k: int = 5) -> str:
        return f"SELECT query, id, rank, round(dd, 8) AS distance FROM (SELECT a.vec_id AS query, c.vec_id AS id, {distance} AS dd, row_number() OVER (PARTITION BY a.vec_id ORDER BY {distance}, c.vec_id) AS rank FROM {signs} a JOIN {signs} c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id) WHERE rank <= {k}"

    chain, ring = "(SELECT p_partkey AS mol_id, p_size AS n FROM part WHERE p_size >= 1)", "(SELECT p_partkey AS mol_id, p_size AS n FROM part WHERE p_size >= 3)"
    trim = "trim(smiles, E' \\t\\n\\r\\x0b\\x0c')"
    yp = "(SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem)"
    clean = f"(SELECT count(DISTINCT {trim}) AS n FROM compounds WHERE smiles IS NOT NULL AND {trim} <> '')"
    conf = "(SELECT l_returnflag AS y, CASE WHEN l_quantity > 33 THEN 'A' WHEN l_linestatus = 'O' THEN 'N' ELSE 'R' END AS p FROM lineitem)"
    return {
        "backbone_torsions": f"{joined} SELECT mol_id, res_seq, {phi[0]} AS cos_phi, {phi[1]} AS sin_phi, {psi[0]} AS cos_psi, {psi[1]} AS sin_psi FROM j",
        "torsion_regions": "SELECT kind, k * c AS n, CASE WHEN kind = 'placed' THEN k * c ELSE 0 END AS named FROM (VALUES ('placed', 3), ('end', 4)) AS t(kind, k), (SELECT count(*) AS c FROM embeddings)",
        "backbone_bonds": f"{joined} SELECT mol_id, res_seq, round(d, 5) AS length FROM (SELECT mol_id, res_seq, sqrt((C_x - Q_x) ** 2 + (C_y - Q_y) ** 2 + (C_z - Q_z) ** 2) AS d FROM j) WHERE d < 2",
        "residue_letters": f"WITH {pts} SELECT mol_id, res_seq, p AS serial, letter FROM pts WHERE name = 'CA'",
        "residue_pairs": f"WITH {pts} SELECT mol_id, p AS serial, p AS r_serial FROM pts WHERE name = 'CA'",
        "secondary_structures": "SELECT vec_id AS mol_id, 7 AS n, 7 AS coil FROM embeddings",
        "selected_atoms": "SELECT vec_id AS mol_id, n, selection FROM embeddings, (VALUES ('all', 21), ('heavy', 21), ('ca', 7), ('backbone', 21)) AS t(selection, n)",
        "contact_residues": f"WITH {pts} SELECT DISTINCT a.mol_id, a.res_seq FROM pts a JOIN pts b ON a.mol_id = b.mol_id AND a.res_seq > 0 AND b.res_seq = 0 AND {gap} <= 2",
        "polar_contacts": f"""WITH {pts}, q AS (SELECT *, CASE WHEN name = 'N' THEN CASE WHEN res_seq % 2 = 0 THEN 1 ELSE -1 END ELSE 0 END AS f FROM pts), j AS (SELECT a.mol_id, a.symbol AS s, b.symbol AS t, a.f * b.f AS ff, {gap} AS dist FROM q a JOIN q b ON a.mol_id = b.mol_id AND a.p < b.p WHERE {gap} <= 4.5),
            k AS (SELECT mol_id, 'hydrogen bond' AS kind, dist FROM j WHERE s = 'N' AND t = 'N' AND dist BETWEEN 2.5 AND 3.6 UNION ALL SELECT mol_id, 'salt bridge', dist FROM j WHERE ff < 0 UNION ALL SELECT mol_id, 'hydrophobic', dist FROM j WHERE s = 'C' AND t = 'C') SELECT mol_id, kind, count(*) AS n, round(sum(dist), 4) AS total FROM k GROUP BY 1, 2""",
        "auto_bonded": f"WITH {pts}, q AS (SELECT *, CASE symbol WHEN 'N' THEN 0.71 ELSE 0.76 END AS r FROM pts) SELECT a.mol_id, a.p AS a, b.p AS b, round({gap}, 5) AS dist FROM q a JOIN q b ON a.mol_id = b.mol_id AND a.p < b.p WHERE {gap} > 0.4 AND {gap} < a.r + b.r + 0.45",
        "mass_centres": f"{com} SELECT mol_id, round(mass, 3) AS mass, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM c",
        "radial_bins": f"{radial} SELECT mol_id, symbol, count(*) AS n, max(floor(sqrt(r2) / rg / 0.5))::INT AS last FROM d JOIN g USING (mol_id) GROUP BY 1, 2",
        "radial_mean": "SELECT * FROM (VALUES ('N', 7.0::DOUBLE), ('C', 14.0::DOUBLE)) AS t(symbol, atoms)",
        "ligand_ranks": """WITH f AS (SELECT l_orderkey AS mol_id, l_suppkey % 3 AS fragment, count(*) AS size, avg((l_returnflag = 'R')::INT) * 100 + CASE WHEN count(*) > 5 AND count(*) < 100 THEN 50 ELSE 0 END AS score FROM lineitem WHERE l_suppkey % 3 <> 2 GROUP BY 1, 2)
            SELECT mol_id, fragment, size, round(score, 6) AS score, row_number() OVER (PARTITION BY mol_id ORDER BY score DESC, fragment) AS rank FROM f""",
        "short_runs": """WITH n AS (SELECT *, coalesce(lag(event_type) OVER w <> event_type, true)::int AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n),
            k AS (SELECT user_id, CASE WHEN event_type IN ('click', 'purchase') AND count(*) OVER (PARTITION BY user_id, run) < 2 THEN 'other' ELSE event_type END AS event_type FROM r) SELECT user_id, event_type, count(*) AS n FROM k GROUP BY 1, 2""",
        "atom_summary": f"SELECT mol_id, n AS atoms, 0 AS donors, 1 AS acceptors, greatest(n - 2, 0) AS lipophilic, 1 AS polar, n AS heavy FROM {chain}",
        "random_shares": "SELECT floor(count(*) * 0.8)::BIGINT AS train, (count(*) - floor(count(*) * 0.8))::BIGINT AS test, true AS in_order FROM compounds",
        "scaffold_split": f"SELECT n, 1 AS groups, 1 AS sides, count(*) AS rows FROM {ring} WHERE n <= 20 GROUP BY 1",
        "compound_scaffold_split": f"SELECT n, 1 AS sides, true AS near FROM {clean}",
        "split_engine": f"SELECT CASE WHEN k = 0 THEN 'Train' ELSE 'Test' END AS split_status, CASE WHEN k = 0 THEN floor(n * 0.8) ELSE n - floor(n * 0.8) END::BIGINT AS n, algorithm FROM {clean}, (SELECT unnest([0, 1]) AS k), (SELECT unnest(['Random', 'Kennard-Stone', 'D-Optimal', 'Duplex']) AS algorithm)",
        "side_by_side": "SELECT place, c_custkey AS t0_c_custkey, p_partkey AS t1_p_partkey, p_size AS t1_p_size FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer) FULL JOIN (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part) USING (place)",
        "pruned_bits": "SELECT i AS bit, round(f, 8) AS frequency FROM (SELECT i, count(*) FILTER (c_custkey % (i + 2) = 0) / count(*) AS f FROM customer, (SELECT unnest(range(8)) AS i) GROUP BY i) WHERE f <= 0.4",
        "percent_of_splits": "SELECT lower(trim(split)) AS s, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM compounds), 6)::DOUBLE AS pct FROM compounds GROUP BY 1",
        "target_ks": """WITH c AS (SELECT lower(trim(split)) AS g, target AS v FROM compounds WHERE target <> -999 AND split IS NOT NULL), t AS (SELECT g, count(*) AS n FROM c GROUP BY 1), o AS (SELECT g, n FROM t WHERE g <> 'train'),
            s AS (SELECT o.g, v, sum(CASE WHEN c.g = 'train' THEN 1.0 / (SELECT n FROM t WHERE g = 'train') ELSE -1.0 / o.n END) AS step FROM c JOIN o ON c.g IN ('train', o.g) GROUP BY 1, 2), f AS (SELECT g, sum(step) OVER (PARTITION BY g ORDER BY v) AS f FROM s) SELECT g AS s, round(max(abs(f)), 8)::DOUBLE AS ks FROM f GROUP BY 1""",
        "residuals": "SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity * 1500) / (SELECT stddev_samp(l_extendedprice - l_quantity * 1500) FROM lineitem), 6) AS r FROM lineitem",
        "external_tests": f"""WITH m AS (SELECT 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, regr_slope(p, y) AS k, regr_slope(y, p) AS kp, abs(sum((y - p) ** 2) / sum(y ** 2) - sum((y - p) ** 2) / sum(p ** 2)) AS z FROM {yp})
            SELECT round(r2, 6) AS r2, round(k, 6) AS k, round(kp, 6) AS k_prime, round(z, 6) AS r2_zero_diff, r2 > 0.5 AND z < 0.3 AND k BETWEEN 0.85 AND 1.15 AND kp BETWEEN 0.85 AND 1.15 AS passed FROM m""",
        "fit_scores": f"SELECT round(1 - (1 - r2) * (n - 1) / (n - 4), 8) AS adjusted, round(sse / n / (1 - 4.0 / n) ** 2, 2) AS lof FROM (SELECT corr(y, p) ** 2 AS r2, count(*) AS n, sum((y - p) ** 2) AS sse FROM {yp})",
        "domain": """WITH c AS (SELECT record_id, descriptor_1 AS x, target AS y, coalesce(lower(trim(split)) = 'train', false) AS tr FROM compounds WHERE target <> -999 AND descriptor_1 <> -999), t AS (SELECT count(*) AS n, avg(x) AS m, var_pop(x) * count(*) AS s, stddev_samp(y) AS sd FROM c WHERE tr)
            SELECT record_id, round(1.0 / n + (x - m) ** 2 / s, 8)::DOUBLE AS leverage, round(y / sd, 6) AS std_residual, 1.0 / n + (x - m) ** 2 / s <= 6.0 / n AND abs(y / sd) <= 3 AS inside FROM c, t""",
        "multiclass": f"""WITH c AS (SELECT y, p, count(*)::DOUBLE AS c FROM {conf} GROUP BY 1, 2), k AS (SELECT k, coalesce((SELECT sum(c) FROM c WHERE y = k), 0) AS t, coalesce((SELECT sum(c) FROM c WHERE p = k), 0) AS q, coalesce((SELECT sum(c) FROM c WHERE y = k AND p = k), 0) AS h FROM (SELECT DISTINCT unnest([y, p]) AS k FROM c)),
            s AS (SELECT sum(t) AS n, sum(h) AS h, sum(t * q) AS tq, sum(t * t) AS tt, sum(q * q) AS qq, avg(CASE WHEN q > 0 THEN h / q ELSE 0 END) AS pm, avg(CASE WHEN t > 0 THEN h / t ELSE 0 END) AS rm, avg(2 * h / (t + q)) AS fm, sum(2 * h / (t + q) * t) / sum(t) AS fw FROM k)
            SELECT round(h / n, 8) AS accuracy, round(rm, 8) AS balanced_accuracy, round((h * n - tq) / sqrt((n * n - qq) * (n * n - tt)), 8) AS mcc, round((h / n - tq / n ** 2) / (1 - tq / n ** 2), 8) AS kappa, round(pm, 8) AS precision_macro, round(rm, 8) AS recall_macro, round(fm, 8) AS f1_macro, round(fw, 8) AS f1_weighted FROM s""",
        "precision_area": "WITH c AS (SELECT l_quantity AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al FROM c) SELECT round(sum(p * tp / al) / sum(p), 8)::DOUBLE AS pr_auc FROM w",
        "class_sizes": "SELECT count(*) AS classes, min(n) AS least, max(n) AS most, 3 AS checked FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_returnflag)",
        "score_matrix": "SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(l_quantity / 10 - 2))), 8) AS two, round(exp(l_discount * 10) / (exp(l_discount * 10) + exp(l_tax * 10) + exp(0.5::DOUBLE)), 8) AS three FROM lineitem",
        "tanimoto_knn": knn(f"1 - {both} / ({one} + {two} - {both})"),
        "dice_knn": knn(f"1 - 2 * {both} / ({one} + {two})"),
        "hamming_knn": knn(f"({one} + {two} - 2 * {both}) / 64"),
        "bit_similarity": f"SELECT query, vec_id, round(s, 8) AS similarity FROM (SELECT a.vec_id AS query, c.vec_id, {both} / ({one} + {two} - {both}) AS s FROM {signs} a JOIN {signs} c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id) WHERE round(s, 8) > 0.45",
        "polar_surface": f"""SELECT mol_id, 20.23 AS tpsa, 20.23 AS tpsawithsp, round(2.491 * (n - 1) + 1.529 + 1.463 * 2 * n, 6) AS molarrefractivity, CASE WHEN n - 1 > 10 THEN 1.0 ELSE 0.0 END AS veberviolations, 5 + least(0.1 * (n - 1), 1) + 0.05 AS syntheticaccessibility, (n - 1)::DOUBLE AS longestchain,
            round((2 + (n - 1) / n * log2(1.0 / n) + sqrt(1.0 / n ** 2)) / log2(1.0 + n), 6) AS hydrophilicfactor FROM {chain} WHERE n > 1""",
        "charge_descriptors": "SELECT mol_id, true AS kept, true AS span FROM molecules WHERE error IS NULL AND smiles IS NOT NULL",
        "space_descriptors": "SELECT id, true AS areas, true AS differences, true AS moments, true AS round FROM structures WHERE smiles IS NOT NULL",
        "umap_map": "SELECT count(*) AS n, 2 AS dims, 0::BIGINT AS missing FROM embeddings",
        "umap_placed": "SELECT count(*) AS n, 0::BIGINT AS missing FROM embeddings",
        "fuzzy_weights": "SELECT count(*) AS rows, 1.0::DOUBLE AS most, 0::BIGINT AS lopsided FROM embeddings",
        "curve_fit": "SELECT * FROM (VALUES (1.0::DOUBLE, 0.1::DOUBLE, 1.577::DOUBLE, 0.895::DOUBLE), (1.0, 0.5, 0.583, 1.334)) AS t(spread, min_dist, a, b)",
        "loo_fit": """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, avg(l_quantity) AS m, var_pop(l_quantity) * count(*) AS ss, count(*) AS n, var_pop(l_extendedprice) * count(*) AS t FROM lineitem),
            e AS (SELECT ((l_extendedprice - a - b * l_quantity) / (1 - 1.0 / n - (l_quantity - m) ** 2 / ss)) ** 2 AS e2, n, t FROM lineitem, s) SELECT max(n) AS n, round(sqrt(sum(e2) / max(n)), 3) AS rmse, round(1 - sum(e2) / max(t), 7) AS q2 FROM e""",
        "fold_fit": "SELECT count(*) AS n, count(*) AS total, 5::BIGINT AS folds, true AS inside FROM lineitem",
        "pls_fit": "SELECT true AS same, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem",
        "genes": "SELECT f AS feature FROM (SELECT 'l_quantity' AS f, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem) ORDER BY r DESC LIMIT 1",
        "foxes": "SELECT f AS feature FROM (SELECT 'l_quantity' AS f, abs(corr(l_quantity, l_extendedprice)) AS r FROM lineitem UNION ALL SELECT 'l_discount', abs(corr(l_discount, l_extendedprice)) FROM lineitem UNION ALL SELECT 'l_tax', abs(corr(l_tax, l_extendedprice)) FROM lineitem) ORDER BY r DESC LIMIT 1",
        "chance_fits": "SELECT 4::BIGINT AS trials, true AS worse",
        "flag_classes": "SELECT s AS set, true AS sane FROM (SELECT unnest(['train', 'test']) AS s)",
        "exclusion_pairs": f"SELECT mol_id, d, n - d AS n FROM {chain}, (SELECT unnest([1, 2, 3]) AS d) WHERE n > d",
        "packed_brands": """WITH RECURSIVE g AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1), room AS (SELECT floor(count(*) * 0.8)::BIGINT AS r FROM part),
            s AS (SELECT 0::BIGINT AS k, 0::BIGINT AS used, '' AS side UNION ALL SELECT g.k, CASE WHEN t.take THEN s.used + g.n ELSE s.used END, CASE WHEN t.take THEN 'Train' ELSE 'Test' END FROM s JOIN g ON g.k = s.k + 1, room, LATERAL (SELECT s.used < r AND (s.used + g.n <= r OR s.used + g.n - r < r - s.used) AS take) t)
            SELECT p_partkey, side AS split_status FROM part JOIN g USING (p_brand) JOIN s ON s.k = g.k""",
        "isolated": "SELECT count(*) + 1 AS n, -1::BIGINT AS top, 0::BIGINT AS outside FROM embeddings",
    }
