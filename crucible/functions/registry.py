"""Registration of the engine's functions for SQL, and of functions of others (plugins)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

_PLUGINS: dict[str, Callable[[SparkSession], None]] = {}


def plugin(name: str) -> Callable:
    """Decorator: a function of the session that registers what a plugin brings; `load` runs it."""

    def add(f: Callable[[SparkSession], None]) -> Callable[[SparkSession], None]:
        _PLUGINS[name] = f
        return f

    return add


def discovered() -> list[str]:
    return sorted(_PLUGINS)


def load(spark: SparkSession, name: str) -> None:
    if name not in _PLUGINS:
        raise KeyError(f"no plugin {name}; there are {discovered()}")
    _PLUGINS[name](spark)


@plugin("molecules")
def molecules(spark: SparkSession) -> None:
    """SQL functions mol_weight, mol_formula, mol_scaffold, mol_key and mol_fingerprint."""
    from crucible.functions.molecules import _each

    def scalar(name: str, kind: str, make: Callable[[], Callable]) -> None:
        @F.pandas_udf(kind)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(_each(s, make()), dtype=object)

        spark.udf.register(name, run)

    def scaffold() -> Callable:
        from crucible.chem.patterns import scaffold as f

        return f

    def bits() -> Callable:
        from crucible.chem.patterns import morgan_bits

        return morgan_bits

    scalar("mol_weight", "double", lambda: lambda m: m.weight())
    scalar("mol_formula", "string", lambda: lambda m: m.formula())
    scalar("mol_scaffold", "string", scaffold)
    scalar("mol_fingerprint", "array<int>", bits)

    @F.pandas_udf("string")
    def key(s: pd.Series) -> pd.Series:
        from crucible.chem.identity import molecule_keys

        return pd.Series(molecule_keys([None if x is None or x != x else x for x in s]), dtype=object)

    spark.udf.register("mol_key", key)


@plugin("substructures")
def substructures(spark: SparkSession) -> None:
    """The table function substructure_matches(smiles, query): one row an atom set. A query is read once a worker, equal texts in a row once."""

    class Matches:
        def __init__(self) -> None:
            self.queries, self.last = {}, (None, None)

        def eval(self, smiles: str, query: str) -> Iterator[tuple]:
            from crucible.chem.graph import Molecule
            from crucible.chem.patterns import match_sets
            from crucible.chem.smiles import SmilesError

            try:
                if query not in self.queries:
                    self.queries[query] = Molecule(query)
                if self.last[0] != (smiles, query):
                    self.last = ((smiles, query), match_sets(Molecule(smiles or ""), self.queries[query]))
            except (SmilesError, KeyError):
                return
            yield from enumerate(self.last[1])

    spark.udtf.register("substructure_matches", F.udtf(Matches, returnType="match int, atoms array<int>", useArrow=True))


class Bus:
    """Typed publish and subscribe on the driver, in the order of subscription."""

    def __init__(self) -> None:
        self._to: dict[type, list[Callable]] = {}

    def subscribe(self, kind: type, f: Callable) -> None:
        self._to.setdefault(kind, []).append(f)

    def unsubscribe(self, kind: type, f: Callable) -> None:
        self._to.get(kind, []).remove(f)

    def publish(self, event: object) -> int:
        """Calls what subscribed to the event's type or one above it; the number of calls."""
        own = [f for kind in type(event).__mro__ for f in self._to.get(kind, [])]
        for f in own:
            f(event)
        return len(own)


def discover(folder: str) -> list[str]:
    """Loads the Python files of a folder that register plugins; files that `suspicious` names something in are left out. The names of new plugins."""
    import importlib.util
    import os

    before = set(_PLUGINS)
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if name.endswith(".py") and not name.startswith("_"):
            with open(path, encoding="utf-8") as f:
                if suspicious(f.read()):
                    continue
            spec = importlib.util.spec_from_file_location(f"crucible_plugin_{name[:-3]}", path)
            spec.loader.exec_module(importlib.util.module_from_spec(spec))
    return sorted(set(_PLUGINS) - before)


#: Modules and calls that a plugin file may not use: fixed values.
FORBIDDEN_MODULES = {"subprocess", "socket", "ctypes", "multiprocessing", "shutil"}
FORBIDDEN_CALLS = {"eval", "exec", "compile", "__import__", "system", "popen", "remove", "rmtree"}


def suspicious(source: str) -> list[str]:
    """Forbidden modules and calls in a plugin's source, and 'syntax' where it can't be read."""
    import ast

    try:
        tree = ast.parse(source)
    except SyntaxError:
        return ["syntax"]
    found = set()
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            found |= {a.name.split(".")[0] for a in n.names} & FORBIDDEN_MODULES
        elif isinstance(n, ast.ImportFrom):
            found |= {(n.module or "").split(".")[0]} & FORBIDDEN_MODULES
        elif isinstance(n, ast.Call):
            found |= {getattr(n.func, "id", getattr(n.func, "attr", ""))} & FORBIDDEN_CALLS
    return sorted(found)
