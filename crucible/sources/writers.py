"""Writers of structure files from tables of (name, atoms, bonds, props); one text a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _fields(df: DataFrame, atoms: str = "atoms") -> list[str]:
    return df.schema[atoms].dataType.elementType.names


def mol_block(name: str = "name", atoms: str = "atoms", bonds: str = "bonds", df_fields: list[str] | None = None) -> Column:
    """A V2000 block; atoms without coordinates stand at the origin. More than 999 atoms or bonds give null.

    Charges and, where the atoms' fields (df_fields) have them, isotopes stand in property lines.
    """
    zero = F.lit(0.0)
    atom = F.transform(atoms, lambda a: F.format_string("%10.4f%10.4f%10.4f %-3s 0  0  0  0  0  0  0  0  0  0  0  0", F.coalesce(a["x"], zero), F.coalesce(a["y"], zero), F.coalesce(a["z"], zero), a["symbol"]))
    bond = F.transform(bonds, lambda b: F.format_string("%3d%3d%3d%3d", b["a"] + 1, b["b"] + 1, b["kind"], F.coalesce(b["stereo"], F.lit(0))))
    named = df_fields or ()
    pair = lambda v: lambda a: F.format_string("%4d%4d", a["idx"] + 1, a[v])

    def listed(kind: str, field: str) -> Column:
        """Property lines of at most eight atoms each."""
        own = F.transform(F.filter(atoms, lambda a: F.coalesce(a[field], F.lit(0)) != 0), pair(field))
        starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda k: (k % 8 == 1) & (k <= F.size(own)))
        return F.transform(starts, lambda k: F.concat(F.format_string(f"M  {kind}%3d", F.least(F.lit(8), F.size(own) - k + 1)), F.array_join(F.slice(own, k, F.lit(8)), "")))

    charge = F.concat(listed("CHG", "formal_charge"), listed("ISO", "isotope")) if "isotope" in named else listed("CHG", "formal_charge")
    head = F.format_string("%3d%3d  0  0  0  0  0  0  0  0999 V2000", F.size(atoms), F.size(bonds))
    lines = F.concat(F.array(F.coalesce(F.col(name), F.lit("")), F.lit("  crucible"), F.lit(""), head), atom, bond, charge, F.array(F.lit("M  END")))
    return F.when((F.size(atoms) <= 999) & (F.size(bonds) <= 999), F.array_join(lines, "\n"))


def sdf_records(df: DataFrame, props: str = "props") -> DataFrame:
    """(value): SDF records with the fields of a map column, then, where df has the columns or the atoms the field, formula, weight and partial charges."""
    own = F.coalesce(F.col(props), F.create_map().cast("map<string,string>"))
    extra = []
    if "formula" in df.columns:
        extra.append(F.struct(F.lit("MOLECULAR_FORMULA").alias("key"), F.col("formula").alias("value")))
    if "weight" in df.columns:
        extra.append(F.struct(F.lit("MOLECULAR_WEIGHT").alias("key"), F.format_string("%.4f", "weight").alias("value")))
    if "partial_charge" in _fields(df):
        charges = F.array_join(F.transform("atoms", lambda a: F.format_string("%.4f", F.coalesce(a["partial_charge"], F.lit(0.0)))), " ")
        charges = F.when(F.exists("atoms", lambda a: F.round(F.coalesce(a["partial_charge"], F.lit(0.0)), 4) != 0), charges)
        extra.append(F.struct(F.lit("PARTIAL_CHARGES").alias("key"), charges.alias("value")))
    entries = F.filter(F.concat(F.map_entries(own), F.array(*extra)) if extra else F.map_entries(own), lambda e: e["key"].isNotNull() & (F.lit(True) if not extra else (e["value"].isNotNull() | F.map_contains_key(own, e["key"]))))
    tags = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), F.coalesce(e["value"], F.lit("")), F.lit("\n"))), "\n")
    return df.select(F.concat(mol_block(df_fields=_fields(df)), F.lit("\n"), tags, F.lit("\n$$$$")).alias("value")).where("value is not null")


def write_sdf(df: DataFrame, path: str) -> None:
    sdf_records(df).write.text(path)


def write_mol2(df: DataFrame, path: str) -> None:
    """MOL2 records; the SYBYL type is the symbol unless the atoms have a sybyl_type, the charge 0 unless they have a partial_charge."""
    has = _fields(df)
    kind = lambda a: a["sybyl_type"] if "sybyl_type" in has else a["symbol"]
    charge = lambda a: F.coalesce(a["partial_charge"], F.lit(0.0)) if "partial_charge" in has else F.lit(0.0)
    at = lambda a, c: F.coalesce(a[c], F.lit(0.0))
    atom = F.transform("atoms", lambda a: F.format_string("%7d %-8s %10.4f %10.4f %10.4f %-8s    1 MOL      %10.4f", a["idx"] + 1, F.concat(a["symbol"], (a["idx"] + 1).cast("string")), at(a, "x"), at(a, "y"), at(a, "z"), kind(a), charge(a)))
    bond = F.transform("bonds", lambda b: F.format_string("%6d %4d %4d %4s", b["idx"] + 1, b["a"] + 1, b["b"] + 1, F.when(b["kind"].cast("string") == "4", "ar").otherwise(b["kind"].cast("string"))))
    head = F.array(F.lit("@<TRIPOS>MOLECULE"), F.coalesce(F.col("name"), F.lit("")), F.format_string(" %d %d 1 0 0", F.size("atoms"), F.size("bonds")), F.lit("SMALL"), F.lit("USER_CHARGES"), F.lit("@<TRIPOS>ATOM"))
    df.select(F.array_join(F.concat(head, atom, F.array(F.lit("@<TRIPOS>BOND")), bond), "\n").alias("value")).write.text(path)


def cif_text(category: str, rows: Column, items: list[str]) -> Column:
    """A category as CIF text: `_category.item value` lines for one row, a loop for several; rows is an array of structs of strings with these items.

    Null is '?', an empty text or one with blanks or quotes is quoted.
    """
    quoted = lambda v: F.when(v.isNull(), "?").when((v == "") | v.rlike(r"[\s'#]") | v.rlike(r"^[_$;\[\]]") | v.isin(".", "?"), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    one = F.array_join(F.array(*[F.concat(F.lit(f"_{category}.{i} "), quoted(rows[0][i])) for i in items]), "\n")
    lines = F.transform(rows, lambda r: F.array_join(F.array(*[quoted(r[i]) for i in items]), " "))
    loop = F.array_join(F.concat(F.array(F.lit("loop_"), *[F.lit(f"_{category}.{i}") for i in items]), lines), "\n")
    return F.when(F.size(rows) == 1, one).when(F.size(rows) > 1, loop).otherwise("")


def write_mmcif(df: DataFrame, path: str) -> None:
    """One data block a record: entry, atom_site with charges, and the bonds as chem_comp_bond."""
    name = F.regexp_replace(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("entry")), r"\s+", "_")
    text = lambda c, a: F.format_string("%.4f", F.coalesce(a[c], F.lit(0.0)))
    atom = F.transform("atoms", lambda a: F.struct(
        F.lit("HETATM").alias("group_PDB"), (a["idx"] + 1).cast("string").alias("id"), a["symbol"].alias("type_symbol"), F.concat(a["symbol"], (a["idx"] + 1).cast("string")).alias("label_atom_id"),
        text("x", a).alias("Cartn_x"), text("y", a).alias("Cartn_y"), text("z", a).alias("Cartn_z"), F.coalesce(a["formal_charge"], F.lit(0)).cast("string").alias("pdbx_formal_charge"),
    ))
    bond = F.transform("bonds", lambda b: F.struct((b["a"] + 1).cast("string").alias("atom_id_1"), (b["b"] + 1).cast("string").alias("atom_id_2"), b["kind"].cast("string").alias("value_order")))
    parts = F.array(
        F.concat(F.lit("data_"), name), F.concat(F.lit("_entry.id "), name), F.lit("#"), cif_text("atom_site", atom, ["group_PDB", "id", "type_symbol", "label_atom_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_formal_charge"]), F.lit("#"),
        cif_text("chem_comp_bond", bond, ["atom_id_1", "atom_id_2", "value_order"]), F.lit("#"),
    )
    df.select(F.array_join(parts, "\n").alias("value")).write.text(path)


def write_contacts(contacts: DataFrame, path: str) -> None:
    """The rows of `operators.structure.contacts` as CSV with a header."""
    contacts.write.option("header", True).csv(path)


WRITERS = {"sdf": write_sdf, "mol": write_sdf, "mol2": write_mol2, "cif": write_mmcif, "mmcif": write_mmcif}


def export(df: DataFrame, path: str) -> None:
    """By the suffix of the path; csv and parquet take any table."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix in ("csv", "parquet"):
        (df.write.option("header", True).csv if suffix == "csv" else df.write.parquet)(path)
    elif suffix in WRITERS:
        WRITERS[suffix](df, path)
    else:
        raise ValueError(f"no writer for .{suffix}")


def upsert(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The existing rows without those whose key comes anew, and the new rows."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)
