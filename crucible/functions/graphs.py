"""Properties of the molecular graph as one struct column."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from crucible.chem.matching import maximum_matching
from crucible.functions.molecules import _each

GRAPH = "struct<connected:boolean,tree:boolean,cycle:boolean,euler:boolean,has_cycle:boolean,components:int,diameter:int,bridges:int,matching:int,symmetry_classes:int,longest_path_ends:int,degrees:array<int>>"


NAMES = tuple(x.split(":")[0] for x in GRAPH[7:-1].replace("array<int>", "a").split(","))
#: Molecules worked on side by side.
TOGETHER = 128
#: Pairs of an atom and a number of bonds whose counts are held at once, unless a single molecule has more.
AT_ONCE = 1 << 21


def _matching(m) -> int:  # noqa: ANN001
    """Bonds of a maximum matching: an end is matched to its neighbour for as long as there are ends, what is left by single rings and blossoms."""
    near = [[j for j, _ in x] for x in m.near]
    degree, gone = [len(x) for x in near], [False] * len(near)
    ends, out = [i for i, x in enumerate(degree) if x == 1], 0
    while ends:
        i = ends.pop()
        if gone[i] or degree[i] != 1:
            continue
        j = next(j for j in near[i] if not gone[j])
        gone[i] = gone[j] = True
        out += 1
        for x in near[j]:
            if not gone[x]:
                degree[x] -= 1
                if degree[x] == 1:
                    ends.append(x)
    for s in range(len(near)):
        if not gone[s] and degree[s] > 1:
            part, gone[s] = [s], True
            for x in part:
                for y in near[x]:
                    if not gone[y]:
                        gone[y] = True
                        part.append(y)
            if all(degree[x] == 2 for x in part):
                out += len(part) // 2
            else:
                at = {x: k for k, x in enumerate(part)}
                out += sum(x >= 0 for x in maximum_matching([[at[y] for y in near[x] if y in at] for x in part])) // 2
    return out


def _spans(ms: list) -> list[tuple[int, int, int]]:
    """(diameter, symmetry classes, longest path between ends) of each molecule, over its heavy atoms.

    Atoms that each atom reaches in k bonds are bits of one row, so a step for all atoms of all molecules is a few operations
    on arrays. The rows' counts of newly reached atoms by element and k are an atom's profile. Molecules are grouped by the
    number of words that their atoms take; a large one is alone.
    """
    import numpy as np

    out: list = [(0, 0, 0)] * len(ms)
    heavy = [range(m.n) if "H" not in m.symbol else m.heavy() for m in ms]
    groups: list[tuple[int, list[int]]] = []
    total = 0
    for x in sorted((x for x, h in enumerate(heavy) if h), key=lambda x: len(heavy[x])):
        n = len(heavy[x])
        words, total = (n + 63) // 64, total + n
        if not groups or groups[-1][0] != words or total * n > AT_ONCE:
            groups.append((words, []))
            total = n
        groups[-1][1].append(x)
    for words, group in groups:
        starts, code, end, src, dst, n = [], [], [], [], [], 0
        group.sort(key=lambda x: len(set(ms[x].symbol)), reverse=True)
        upto: list[int] = []  # of an element's number in its molecule: the rows of molecules that have so many
        for x in group:
            m, h = ms[x], heavy[x]
            own: dict[str, int] = {}
            starts.append(n)
            code += [own.setdefault(m.symbol[i], len(own)) for i in h]
            end += [len(m.near[k]) <= 1 for k in range(len(h))]
            if len(h) == m.n:
                src += [a + n for a, _ in m.ends]
                dst += [b + n for _, b in m.ends]
            else:
                at = {i: k + n for k, i in enumerate(h)}
                src += [at[a] for a, b in m.ends if a in at and b in at]
                dst += [at[b] for a, b in m.ends if a in at and b in at]
            n += len(h)
            upto += [0] * (len(own) - len(upto))
            upto[: len(own)] = [n] * len(own)
        first, size = np.array(starts), np.diff([*starts, n])
        mol, code, end = np.repeat(np.arange(len(group)), size), np.array(code), np.flatnonzero(end)
        k = np.arange(n) - first[mol]
        reached = np.zeros((words, n), np.uint64)
        reached[k >> 6, np.arange(n)] = np.uint64(1) << (k & 63).astype(np.uint64)
        masks = [np.bitwise_or.reduceat(np.where(code == s, reached, np.uint64(0)), first, axis=1)[:, mol[:u]] for s, u in enumerate(upto)]
        is_end = np.zeros(n, bool)
        is_end[end] = True
        ends = np.bitwise_or.reduceat(np.where(is_end, reached, np.uint64(0)), first, axis=1)[:, mol[end]]
        a, b = np.array(src + dst, np.int64), np.array(dst + src, np.int64)
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        place = np.arange(len(a)) - np.searchsorted(a, a)  # of a neighbour among its atom's
        links = [(a[place == p], b[place == p]) for p in range(int(place.max(initial=-1)) + 1)]
        whole = []  # of the first two neighbours, for all atoms; an atom stands for one that is missing
        for x, y in links[:2]:
            whole.append(np.arange(n))
            whole[-1][x] = y
        wide = np.min_scalar_type(64 * words)
        profile = [np.stack([code == s for s in range(len(upto))], axis=1).astype(wide)]
        far, longest, step = np.zeros(len(group), int), np.zeros(len(group), int), 0
        while True:
            step += 1
            more = reached.copy()
            for y in whole:
                more |= reached.take(y, axis=1)
            for x, y in links[2:]:
                for w in range(words):
                    more[w][x] |= reached[w].take(y)
            new = more ^ reached
            hit = mol[np.bitwise_or.reduce(new, axis=0) != 0]
            if not len(hit):
                break
            reached = more
            far[hit] = step
            longest[mol[end[(new.take(end, axis=1) & ends).any(axis=0)]]] = step
            profile.append(counts := np.zeros((n, len(upto)), wide))
            for c, (x, u) in enumerate(zip(masks, upto, strict=True)):
                count = np.bitwise_count(new[:, :u] & x)
                counts[:u, c] = count[0] if words == 1 else count.sum(axis=0, dtype=wide)
        rows = np.ascontiguousarray(np.concatenate(profile, axis=1))
        width, text = rows.shape[1] * rows.itemsize, rows.tobytes()
        for x, s, z, d, e in zip(group, starts, size.tolist(), far.tolist(), longest.tolist(), strict=True):
            out[x] = (d, len({text[i * width : (i + 1) * width] for i in range(s, s + z)}), e)
    return out


def properties_of(ms: list) -> list[dict]:
    """The properties in GRAPH of each molecule."""
    out = []
    for m, (diameter, classes, ends) in zip(ms, _spans(ms), strict=True):
        degree, parts, e = [len(x) for x in m.near], len(set(m.component)), len(m.ends)
        out.append(dict(
            connected=parts == 1, tree=parts == 1 and e == m.n - 1, cycle=parts == 1 and m.n > 2 and all(x == 2 for x in degree), euler=all(x % 2 == 0 for x in degree), has_cycle=e > m.n - parts, components=parts, diameter=diameter,
            bridges=e - len(m.cyclic_bonds), matching=_matching(m), symmetry_classes=classes, longest_path_ends=ends, degrees=degree,
        ))
    return out


def properties(m) -> dict:  # noqa: ANN001
    return properties_of([m])[0]


def graph_properties(smiles: Column | str) -> Column:
    """Connectedness, tree, cycle, Euler property, components, diameter, bridges, maximum matching, symmetry classes and degrees; null where the text can't be read."""

    @F.pandas_udf(GRAPH)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            got = _each(s, properties)
            yield pd.DataFrame([[None] * len(NAMES) if g is None else [g[n] for n in NAMES] for g in got], columns=NAMES)

    return run(smiles)


def overview(smiles: Column | str, query: str) -> Column:
    """A struct of scaffold, names of the functional groups, atom sets on which the query stands and graph properties; a molecule is read once for all, equal texts of a batch once."""
    from crucible.functions.molecules import shipped

    shipped()
    kind = f"struct<scaffold:string,groups:array<string>,matches:int,graph:{GRAPH}>"

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        from crucible.chem.graph import Molecule
        from crucible.chem.patterns import match_sets, scaffold
        from crucible.chem.perceive import functional_groups
        from crucible.chem.smiles import SmilesError

        q, one = Molecule(query), pa.bool_()
        graph = pa.struct([(n, one if n in ("connected", "tree", "cycle", "euler", "has_cycle") else pa.list_(pa.int32()) if n == "degrees" else pa.int32()) for n in NAMES])
        out = pa.struct([("scaffold", pa.string()), ("groups", pa.list_(pa.string())), ("matches", pa.int32()), ("graph", graph)])
        unread = dict(scaffold=None, groups=None, matches=None, graph=dict.fromkeys(NAMES))

        def read(text: str):  # noqa: ANN202
            try:
                return Molecule(text)
            except (SmilesError, KeyError):
                return None

        def some(texts: Iterable[str]) -> list[dict]:
            gc.disable()  # molecules hold no cycles of references, and looking for such took an eighth of the time
            try:
                ms = [read(x) for x in texts]
                g = iter(properties_of([m for m in ms if m is not None]))
                return [unread if m is None else dict(scaffold=scaffold(m), groups=[n for n, _ in functional_groups(m)], matches=len(match_sets(m, q)), graph=next(g)) for m in ms]
            finally:
                gc.enable()

        for s in batches:
            texts = s.dictionary_encode()
            known = texts.dictionary.to_pylist()
            got = []
            order = sorted(range(len(known)), key=lambda i: len(known[i]))  # molecules of like size take like many steps
            for k in range(0, len(known), TOGETHER):
                got.append(pa.array(some(known[i] for i in order[k : k + TOGETHER]), out))
            got.append(pa.array([unread], out))
            at = np.empty(len(known) + 1, np.int64)
            at[[*order, len(known)]] = np.arange(len(known) + 1)
            yield pa.concat_arrays(got).take(pa.array(at).take(pc.fill_null(texts.indices, len(known))))

    return run(smiles)


#: Kernels by name: module, function of a molecule, type of its value.
KERNELS = {
    "cycles": ("crucible.chem.cycles", lambda f: lambda m: f.all_cycles(m.near), "array<array<int>>"),
    "bridges": ("crucible.chem.cycles", lambda f: lambda m: f.bridges(m.near), "array<int>"),
    "ring_systems": ("crucible.chem.cycles", lambda f: lambda m: f.without_bridges(m.near), "array<array<int>>"),
    "fragments": ("crucible.chem.cycles", lambda f: lambda m: f.parts(m.near), "array<array<int>>"),
    "bad_valences": ("crucible.chem.perceive", lambda f: f.bad_valences, "array<int>"),
    "sybyl_types": ("crucible.chem.perceive", lambda f: f.sybyl_types, "array<string>"),
    "double_bond_stereo": ("crucible.chem.perceive", lambda f: lambda m: [dict(a=a, b=b, stereo=x) for a, b, x in f.double_bond_stereo(m)], "array<struct<a:int,b:int,stereo:string>>"),
    "centres": ("crucible.chem.perceive", lambda f: lambda m: [dict(atom=i, mark=x, neighbours=n) for i, x, n in f.centres(m)], "array<struct<atom:int,mark:string,neighbours:array<int>>>"),
    "morgan_ranks": ("crucible.chem.perceive", lambda f: f.morgan_ranks, "array<long>"),
    "unique_numbers": ("crucible.chem.perceive", lambda f: f.unique_numbers, "array<int>"),
    "symmetry_classes": ("crucible.chem.perceive", lambda f: f.symmetry_classes, "array<array<int>>"),
    "structure_hash": ("crucible.chem.perceive", lambda f: f.structure_hash, "string"),
    "longest_chain": ("crucible.chem.perceive", lambda f: f.longest_chain, "array<int>"),
    "functional_groups": ("crucible.chem.perceive", lambda f: lambda m: [dict(name=n, atoms=a) for n, a in f.functional_groups(m)], "array<struct<name:string,atoms:array<int>>>"),
    "named_rings": ("crucible.chem.perceive", lambda f: lambda m: [dict(name=n, atoms=a) for n, a in f.named_rings(m)], "array<struct<name:string,atoms:array<int>>>"),
}


def of_molecule(smiles: Column | str, name: str) -> Column:
    """A property of KERNELS of each molecule; null where the text can't be read."""
    from crucible.functions.molecules import _udf

    module, pick, kind = KERNELS[name]

    def make():  # noqa: ANN202
        from importlib import import_module

        return pick(import_module(module))

    return _udf(kind, make)(smiles)


def path_between(smiles: Column | str, a: int, b: int, avoid: tuple[int, ...] = ()) -> Column:
    """The shortest path between two atoms as an array; null where there is none, an atom is missing or the text can't be read."""
    from crucible.functions.molecules import _udf

    def make():  # noqa: ANN202
        from crucible.chem.cycles import path_between as f

        return lambda m: f(m.near, a, b, frozenset(avoid)) if max(a, b) < m.n else None

    return _udf("array<int>", make)(smiles)


def with_hydrogens(smiles: Column | str) -> Column:
    """A struct of atoms and bonds in which every hydrogen is an atom of its own."""
    from crucible.functions.molecules import ATOM, BOND, _each, shipped

    shipped()

    @F.pandas_udf(f"struct<atoms:array<{ATOM}>,bonds:array<{BOND}>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from crucible.chem.perceive import with_hydrogens as f

        for s in batches:
            got = _each(s, f)
            yield pd.DataFrame([(None, None) if g is None else g for g in got], columns=["atoms", "bonds"])

    return run(smiles)


def without_atoms(mols, gone):  # noqa: ANN001, ANN201
    """mols (mol_id, atoms, bonds) without the atoms (mol_id, idx) of `gone`; bonds to them go too and what stays is numbered anew.

    One aggregation of the numbers by molecule and one join; a molecule with nothing gone is unchanged. Further columns are dropped.
    """
    g = gone.groupBy("mol_id").agg(F.collect_set("idx").alias("gone"))
    m = mols.select("mol_id", "atoms", "bonds").join(g, "mol_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.filter("atoms", lambda a: ~F.array_contains(F.col("gone"), a["idx"]))
    m = m.withColumn("kept", kept).withColumn("old", F.transform("kept", lambda a: a["idx"]))
    new = lambda i: (F.array_position(F.col("old"), i) - 1).cast("int")
    atoms = F.transform("kept", lambda a, i: a.withField("idx", i.cast("int")))
    bonds = F.filter("bonds", lambda b: F.array_contains(F.col("old"), b["a"]) & F.array_contains(F.col("old"), b["b"]))
    bonds = F.transform(bonds, lambda b, i: b.withField("idx", i.cast("int")).withField("a", new(b["a"])).withField("b", new(b["b"])))
    return m.select("mol_id", atoms.alias("atoms"), bonds.alias("bonds"))


def without_bonds(mols, gone):  # noqa: ANN001, ANN201
    """mols (mol_id, atoms, bonds) without the bonds (mol_id, idx) of `gone`; the others are numbered anew."""
    g = gone.groupBy("mol_id").agg(F.collect_set("idx").alias("gone"))
    m = mols.select("mol_id", "atoms", "bonds").join(g, "mol_id", "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
    bonds = F.transform(F.filter("bonds", lambda b: ~F.array_contains(F.col("gone"), b["idx"])), lambda b, i: b.withField("idx", i.cast("int")))
    return m.select("mol_id", "atoms", bonds.alias("bonds"))


def with_atom(mols, symbol: str, charge: int = 0):  # noqa: ANN001, ANN201
    """mols with one more atom, the last, in every molecule."""
    atom = F.struct(F.size("atoms").alias("idx"), F.lit(symbol).alias("symbol"), F.lit(charge).alias("formal_charge"), F.lit(None).cast("int").alias("isotope"), F.lit(0).alias("n_h"), F.lit(False).alias("aromatic"), F.lit("sp3").alias("hyb"))
    return mols.withColumn("atoms", F.array_append("atoms", atom))


def with_bonds(mols, new):  # noqa: ANN001, ANN201
    """mols with the bonds (mol_id, a, b, order_kek) of `new`: undirected, once a pair, none from an atom to itself or to a missing one, none that is there already."""
    pair = F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    n = new.where("a <> b").select("mol_id", pair.alias("p"), "order_kek").groupBy("mol_id", "p").agg(F.max("order_kek").alias("order_kek"))
    n = n.groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("p.a", "p.b", "order_kek"))).alias("new"))
    m = mols.join(n, "mol_id", "left")
    there = F.transform("bonds", lambda b: F.struct(F.least(b["a"], b["b"]).alias("a"), F.greatest(b["a"], b["b"]).alias("b")))
    fresh = F.filter(F.coalesce("new", F.expr("cast(array() as array<struct<a:int,b:int,order_kek:int>>)")), lambda x: ~F.array_contains(there, F.struct(x["a"].alias("a"), x["b"].alias("b"))) & (x["a"] >= 0) & (x["b"] < F.size("atoms")))
    added = F.transform(fresh, lambda x, i: F.struct((F.size("bonds") + i).cast("int").alias("idx"), x["a"].alias("a"), x["b"].alias("b"), x["order_kek"].cast("int").alias("order_kek"), F.lit(False).alias("aromatic"), F.lit(False).alias("in_ring")))
    return m.withColumn("bonds", F.concat("bonds", added)).drop("new")


def optimised(smiles: Column | str, rounds: int = 60) -> Column:
    """(converged, energy by term, coordinates) of each molecule minimised in the force field of crucible.chem.forcefield; null where the text can't be read."""
    from crucible.functions.molecules import shipped

    shipped()

    @F.pandas_udf("struct<converged:boolean,terms:map<string,double>,xyz:array<array<double>>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from crucible.chem.forcefield import optimised as f

        for s in batches:
            got = _each(s, lambda m: f(m, rounds))
            rows = [(None, None, None) if g is None else (g[2], g[1], g[0].tolist()) for g in got]
            yield pd.DataFrame(rows, columns=["converged", "terms", "xyz"])

    return run(smiles)
