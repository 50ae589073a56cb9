"""Splits, statistics, proteins, models and maps on small tables, with nulls, ties and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crucible import runtime
from crucible.functions import registry
from crucible.operators import dataset, embedding, models, residues, similarity, statistics


def test_splits(spark):
    df = spark.createDataFrame([(i, f"s{i % 7}") for i in range(101)], "id long, g string")
    for ratio, want in ((0.8, 80), (0.0, 0), (1.0, 101)):
        assert dataset.random_split(df, "id", ratio).where("split_status = 'Train'").count() == want
    assert dataset.random_split(df.limit(0), "id", 0.5).count() == 0
    # groups of 6, 4 and 3 rows to 7: the first fits, the second is further off than none, the third too
    g = spark.createDataFrame([(i, "a" if i < 6 else "b" if i < 10 else "c") for i in range(13)], "id long, g string")
    side = {r.g: r.split_status for r in dataset.group_packing(g, "g", 0.55).collect()}
    assert side == {"a": "Train", "b": "Test", "c": "Test"}
    side = {r.g: r.split_status for r in dataset.group_packing(g, "g", 0.7).collect()}  # 9 rows: 6 and then 4, one too many
    assert side == {"a": "Train", "b": "Train", "c": "Test"}
    x = np.random.default_rng(3).normal(size=(40, 3))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, x array<double>")
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    i, j = np.unravel_index(np.argmax(d), d.shape)
    train, test, rest = [i, j], [], set(range(40)) - {i, j}
    own = sorted(rest)
    a, b = np.unravel_index(np.argmax(d[np.ix_(own, own)]), (len(own), len(own)))
    test = [own[a], own[b]]
    rest -= set(test)
    while rest:
        to = train if len(train) / (len(train) + len(test)) < 0.7 and len(train) < 28 else test
        best = max(sorted(rest), key=lambda k: d[k, to].min())
        to.append(best)
        rest.remove(best)
    got = {r.id for r in dataset.duplex(v, "id", "x", 0.7).where("split_status = 'Train'").collect()}
    assert got == set(map(int, train))


def test_random_split_within_a_bucket_of_hashes(spark):
    """So many rows that several share the 16 bits at which the sides part."""
    df = spark.range(200_000)
    h = F.xxhash64("id", F.lit(42))
    order = [r.id for r in df.orderBy(h, "id").collect()]
    for want in (100_000, 100_001, 100_002, 100_003):
        got = {r.id for r in dataset.random_split(df, "id", (want + 0.5) / 200_000).where("split_status = 'Train'").collect()}
        assert got == set(order[:want])


def test_split_engine(spark):
    df = spark.createDataFrame([(i, s, float(i)) for i, s in enumerate(["CCO", "c1ccccc1C", "Cc1ccccc1", "C1CC1C", "CCC", "CCN", " CCO ", None, "", "N(", "c1ccccc1CC"])], "id long, smiles string, y double")
    for name in dataset.SPLITTERS[:6]:
        r = dataset.split_dataset(df, name, 0.7, "smiles", "id").collect()
        assert {x.id for x in r} == ({0, 1, 2, 3, 4, 5, 9, 10} if name in ("Random", "Scaffold") else {0, 1, 2, 3, 4, 5, 10}) and {x.split_status for x in r} == {"Train", "Test"}, name
    s = {r.id: (r.scaffold, r.split_status) for r in dataset.scaffold_split(dataset.cleanse(df, "smiles", "id"), "smiles", "id", 0.7).collect()}
    assert s[1] == s[2] == s[10] and s[0][0] != s[4][0]
    with pytest.raises(ValueError):
        dataset.split_dataset(df, "None such", 0.7, "smiles", "id")


def test_bits_and_places(spark):
    df = spark.createDataFrame([([0, 1, 3],), ([0, 1],), ([3],), (None,), ([],)], "b array<int>")
    got = {r.bit: r.frequency for r in dataset.prune_bits(df, "b", 5, min_variance=0.1).collect()}
    assert got == {0: 0.5, 3: 0.5}  # 1 is set where 0 is; 2 and 4 never
    assert {r.bit for r in dataset.prune_bits(df, "b", 5, duplicates=False, max_frequency=0.4).collect()} == {2, 4}
    a, b = spark.createDataFrame([(3,), (1,), (2,)], "x long"), spark.createDataFrame([(9,)], "x long")
    assert sorted(tuple(r) for r in dataset.concat_columns([a, b], ["x", "x"]).collect()) == [(0, 1, 9), (1, 2, None), (2, 3, None)]


def test_curation_of_molecules(spark):
    df = spark.createDataFrame([(1, "CCO", 5.0, None), (2, "OCC", 7.0, "b"), (3, "CCO", 9.0, "c"), (4, "C(", 1.0, "d"), (5, "CC", None, "e")], "id long, smiles string, v double, s string")
    r = dataset.curate_molecules(df, "smiles", "v", first_of=("s",), order_col="id").collect()
    assert len(r) == 1 and (r[0].value, r[0].n, r[0].s) == (7.0, 3, "b")


def test_more_statistics(spark):
    x = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b"), (None, "a")], "y string, p string")
    m = statistics.class_metrics(x, "y", "p").first()
    assert m.accuracy == 0.5 and m.recall_macro == pytest.approx(0.5) and m.precision_macro == pytest.approx((1 + 1 / 3 + 0) / 3)
    s = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (None, 0.5)], "y int, s double")
    assert statistics.average_precision(s, "y", "s").first().pr_auc == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert statistics.check_classes(x, "y", "Ternary") == 3 and tuple(statistics.class_counts(x, "y").first()) == (3, 1, 2)
    with pytest.raises(ValueError):
        statistics.check_classes(x, "y", "Binary")
    t = spark.createDataFrame([(1.0, 1.1), (2.0, 1.9), (3.0, 3.2), (4.0, 3.9), (None, 1.0)], "y double, p double")
    assert statistics.external_criteria(t, "y", "p").first().passed
    k = spark.createDataFrame([("r", float(i)) for i in range(50)] + [("o", 10.0)] * 7 + [("o", 48.5)], "g string, v double")
    assert statistics.kolmogorov_smirnov(k, "g", "v", "r").first().ks == pytest.approx(7 / 8 - 11 / 50)
    assert statistics.kolmogorov_smirnov(k.limit(0), "g", "v", "r").count() == 0


def test_models_from_moments(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=60) + 5
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))] + [(99, None, 1.0, 1.0, 1.0)], "id long, a double, b double, c double, y double")
    one = np.column_stack([np.ones(60), x])
    w = np.linalg.lstsq(one, y, rcond=None)[0]
    m = models.Moments.by_fold(df, ["a", "b", "c"], "y")[0]
    assert np.allclose(m.ridge()[0], w[1:]) and m.ridge()[1] == pytest.approx(w[0]) and np.allclose(m.pls(3)[0], w[1:])
    h = np.diag(one @ np.linalg.pinv(one.T @ one) @ one.T)
    press = float((((y - one @ w) / (1 - h)) ** 2).sum())
    r = models.leave_one_out(df, ["a", "b", "c"], "y").first()
    assert r.n == 60 and r.press == pytest.approx(press) and r.q2 == pytest.approx(1 - press / ((y - y.mean()) ** 2).sum())
    cv = {r.fold: r for r in models.cross_validate(df, "id", ["a", "b", "c"], "y").collect()}
    assert cv[-1].n == 60 and cv[-1].q2 > 0.95
    assert set(models.select_by_genes(df, ["a", "b", "c"], "y", most=2)) == {"a", "b"} == set(models.select_by_foxes(df, ["a", "b", "c"], "y", 2))
    assert models.leave_one_out(df.limit(0), ["a"], "y").count() == 0 and models.select_by_genes(df.limit(0), ["a"], "y") == []


def test_proteins(spark):
    rad, atoms, serial = np.radians, [], 0
    for r in range(14):  # an ideal helix: 100 degrees and 1.5 Å a residue
        for name, radius, turn, rise in (("N", 1.55, -27.6, -0.87), ("CA", 2.29, 0.0, 0.0), ("C", 1.67, 26.4, 1.11), ("O", 2.03, 21.9, 2.31)):
            t = rad(100 * r + turn)
            atoms.append((1, "A", r + 1, "ALA" if r else "GLY", name, serial, radius * np.cos(t), radius * np.sin(t), 1.5 * r + rise))
            serial += 1
    schema = "mol_id long, chain_id string, res_seq int, res_name string, pdb_name string, serial int, x double, y double, z double"
    a = spark.createDataFrame([(*t[:6], *map(float, t[6:])) for t in atoms], schema)
    ss = "".join(r.ss_type for r in residues.secondary_structure(a).orderBy("res_seq").collect())
    assert ss[2:10] == "H" * 8
    t = {r.res_seq: (r.phi, r.psi) for r in residues.torsions(a).collect()}
    assert t[1][0] is None and t[14][1] is None and -80 < t[5][0] < -40 and -70 < t[5][1] < -25
    assert residues.peptide_bonds(a).count() == 13 and residues.torsions(a.where("res_seq <> 5")).where("res_seq = 6").first().phi is None
    p = residues.pairs_by_sequence(a, a.where("res_seq > 3"), opening=-1.0).collect()
    assert {(r.serial, r.r_serial) for r in p} == {(4 * k + 1, 4 * k + 1) for k in range(3, 14)}
    assert residues.secondary_structure(a.limit(0)).count() == 0 and residues.contact_residues(a.where("res_seq = 1"), a.where("res_seq > 1"), 2.0).count() == 1
    assert residues.assign_structure(*[np.full((3, 3), np.nan)] * 4) == ["C"] * 3
    g = spark.createDataFrame([(50, 50, 1.0)], "i int, j int, density double")
    q = spark.createDataFrame([(0.5, 0.5), (180.0, -180.0)], "phi double, psi double")
    assert [r.region for r in residues.density_region(q, g, (("core", 0.5),)).orderBy("phi").collect()] == ["core", "outlier"]


def test_maps(spark):
    rng = np.random.default_rng(42)
    x = np.vstack([rng.normal(size=(25, 6)), rng.normal(size=(25, 6)) + 9])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(90, None)], "id long, x array<double>")
    a, b = embedding.curve_parameters()
    assert (a, b) == (pytest.approx(1.577, abs=1e-3), pytest.approx(0.895, abs=1e-3))
    m = embedding.fit_umap(df, "id", "x", 10, epochs=60)
    y = {r.id: np.array(r.y) for r in m.embedding.collect()}
    assert set(y) == set(range(50)) and all(np.isfinite(v).all() and v.shape == (2,) for v in y.values())
    left, right = (np.array([y[i] for i in part]) for part in (range(25), range(25, 50)))
    assert np.linalg.norm(left.mean(0) - right.mean(0)) > 0.5 * (left.std() + right.std())
    new = spark.createDataFrame([(1000 + i, (x[i] + 0.01).tolist()) for i in range(5)], "id long, x array<double>")
    z = embedding.transform_umap(m, new, "id", "x").collect()
    assert len(z) == 5 and all(np.isfinite(r.y).all() for r in z)
    assert embedding.fit_umap(df.where("id < 0"), "id", "x").embedding.count() == 0 and embedding.fit_umap(df.where("id = 1"), "id", "x").embedding.first().y == [0.0, 0.0]
    t = {r.id: np.array(r.y) for r in embedding.tsne(df, "id", "x", steps=150).collect()}
    assert len(t) == 50 and all(np.isfinite(v).all() for v in t.values())
    o = embedding.outliers(df.union(spark.createDataFrame([(77, [80.0] * 6)], "id long, x array<double>")), "id", "x", trees=20)
    assert o.orderBy(F.desc("score")).first().id == 77 and o.where("outlier").count() <= 4


def test_neighbours_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 3)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, (30, 4)).astype(float)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    for metric in ("euclidean", "cityblock", "hamming"):
        got = {}
        for r in similarity.nearest(df, "id", "v", 4, metric, df).orderBy("query", "rank").collect():
            got.setdefault(r.query, []).append(r.id)
        d = similarity.distances(x, x, metric)
        assert got == {i: sorted((j for j in range(30) if j != i), key=lambda j: (d[j, i], j))[:4] for i in range(30)}


def test_plugins_and_events(tmp_path):
    (tmp_path / "good.py").write_text("from crucible.functions.registry import plugin\n@plugin('extra')\ndef f(spark): pass\n")
    (tmp_path / "bad.py").write_text("import subprocess\n")
    (tmp_path / "_hidden.py").write_text("raise ValueError\n")
    assert registry.discover(str(tmp_path)) == ["extra"] and registry.suspicious("eval('1')") == ["eval"] and registry.suspicious("def (") == ["syntax"]
    bus, seen = registry.Bus(), []
    bus.subscribe(Exception, seen.append)
    bus.subscribe(ValueError, seen.append)
    assert bus.publish(ValueError()) == 2 and bus.publish(KeyError()) == 1 and bus.publish(3) == 0 and len(seen) == 3


def test_written_tables_are_dropped(spark):
    runtime.written(spark.range(3))
    n = len(runtime.tables_of(spark))
    a = runtime.written(spark.range(5))
    assert runtime.drop_written(spark, keep=1) == n and a.count() == 5 and len(runtime.tables_of(spark)) == 1


def test_random_split_query_of_many_rows(spark, tmp_path):
    """The query places every record once, also where several share the bucket of the last Train row."""
    from crucible.plans import table_queries

    h = F.shiftright(F.xxhash64("record_id", F.lit(42)), 48)
    ids = spark.range(400_000).select(F.col("id").alias("record_id"))
    shared = ids.groupBy(h.alias("b")).count().where("count >= 5 and b between 0 and 100").agg(F.min("b")).first()[0]
    low, one, high = ids.where(h < 0).limit(78), ids.where(h == shared).limit(5), ids.where(h > 100).limit(17)
    low.union(one).union(high).write.parquet(str(tmp_path / "compounds.parquet"))  # 80 of 100: two of the five
    r = table_queries.random_split(spark, str(tmp_path))
    assert {x.split_status: x["count"] for x in r.groupBy("split_status").count().collect()} == {"Train": 80, "Test": 20}
    assert r.select("record_id").distinct().count() == 100


def test_sequential_splitters_of_many_rows(spark, monkeypatch):
    """More rows than a scan takes: the choices are those of the scan, also with ties and repeated rows, and no number of rows is an error."""
    r = np.random.default_rng(5)
    sets = [np.round(r.normal(size=(400, 3)), 1), np.repeat(r.normal(size=(90, 2)), 4, axis=0), np.zeros((70, 3))]
    monkeypatch.setattr(dataset, "_sequential", lambda df, i, f, pick, most=None: pick)
    for x in sets:
        for f in (dataset.kennard_stone, dataset.duplex, dataset.d_optimal):
            pick = f(None, "i", "x", 0.7)
            got = []
            for most in (10**9, 16):
                monkeypatch.setattr(dataset, "SCANNED_ROWS", most)
                got.append(pick(x))
            assert got[0] == got[1]
    monkeypatch.undo()
    v = spark.range(20_001).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 7)).alias("x"))
    assert dataset.d_optimal(v, "id", "x", 0.01).where("split_status = 'Train'").count() == 200


def test_boruta_split_of_many_rows(spark, monkeypatch):
    """More rows than a scan of all of them a step would take are split whole; the forests are tested elsewhere."""
    monkeypatch.setattr(dataset, "boruta_features", lambda x, cols, target: cols[:2])
    n = dataset.SEQUENTIAL_ROWS + 100
    df = spark.range(n).select("id", F.concat(F.lit("C"), F.col("id").cast("string")).alias("smiles"), F.rand(1).alias("y"), *[F.rand(s).alias(f"d{s}") for s in (2, 3, 4)])
    r = dataset.split_dataset(df, "Boruta", 0.8, "smiles", "id", "y", ["d2", "d3", "d4"])
    assert {x.split_status: x["count"] for x in r.groupBy("split_status").count().collect()} == {"Train": int(n * 0.8), "Test": n - int(n * 0.8)}


def test_equal_texts_are_worked_on_once(spark, tmp_path, monkeypatch):
    """However the rows of a text lie, its descriptors are worked out in one place, and every row gets them."""
    from crucible.plans import molecule_queries as Q

    texts = ["CCO", "c1ccccc1", "CC(=O)O", "C1CC1"]
    rows = spark.range(400).select(F.col("id").alias("mol_id"), F.element_at(F.array(*map(F.lit, texts)), (F.col("id") % 4 + 1).cast("int")).alias("smiles"), F.lit(None).cast("string").alias("error"))
    rows.repartition(8).write.parquet(str(tmp_path / "molecules.parquet"))
    where = runtime.gathered(spark.read.parquet(str(tmp_path / "molecules.parquet")), "smiles").select("smiles", F.spark_partition_id().alias("p"))
    assert where.distinct().count() == 4
    r = Q.all_descriptors_of_molecules(spark, str(tmp_path))
    got = {(x.n, x.w) for x in r.groupBy(F.col("mol_id") % 4).agg(F.count("*").alias("n"), F.countDistinct("MolecularWeight", "Chi4n", "ATS3m").alias("w")).collect()}
    assert got == {(100, 1)}


def test_kernels_of_paths():
    """Distances, path products and autocorrelations against plain definitions."""
    from itertools import permutations
    from math import prod, sqrt

    from crucible.chem.descriptors import compute
    from crucible.chem.graph import Molecule

    for text in ("CC(C)Oc1ccncc1", "C1CC1.CO", "[H]OC(C)(C)C"):
        m = Molecule(text)
        a, n = m.adjacency(), len(m.heavy())
        d = np.where(np.eye(n) > 0, 0, np.where(a > 0, 1, np.inf))
        for k in range(n):
            d = np.minimum(d, d[:, k, None] + d[None, k])
        assert (m.distances() == d).all()
        deg = a.sum(axis=0)
        paths = [p for p in permutations(range(n), 4) if p[0] < p[-1] and all(a[i, j] for i, j in zip(p, p[1:], strict=False))]
        i, j = np.nonzero(np.triu(np.where(np.isfinite(d), d, 0)) == 2)
        got = compute(m, ["Chi3n", "ATS2d", "SzegedIndex"])
        near = [((d[x] < d[y]).sum() * (d[y] < d[x]).sum()) for x, y in zip(*np.nonzero(np.triu(a)), strict=True)]
        assert np.allclose(got, [sum(1 / sqrt(prod(deg[x] for x in p)) for p in paths), (deg[i] * deg[j]).sum(), sum(near)])
