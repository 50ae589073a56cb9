"""Readers of structure files. Each gives one row a record with its atoms and bonds; lines that can't be read are skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "array<struct<idx:int,symbol:string,x:double,y:double,z:double,formal_charge:int,isotope:int>>"
BOND = "array<struct<idx:int,a:int,b:int,kind:int,stereo:int>>"
_CHARGE = {0: 0, 1: 3, 2: 2, 3: 1, 4: 0, 5: -1, 6: -2, 7: -3}  # fixed values: charge codes of the atom block


def smiles_file(spark: SparkSession, path: str) -> DataFrame:
    """(smiles, name) of a file with `SMILES [name]` a line; blank lines are skipped."""
    line = F.trim("value")
    return spark.read.text(path).where(F.length(line) > 0).select(F.regexp_extract(line, r"^(\S+)", 1).alias("smiles"), F.nullif(F.regexp_extract(line, r"^\S+\s+(.*)$", 1), F.lit("")).alias("name"))


def csv_file(spark: SparkSession, path: str, sep: str | None = None, schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """A table with a header. Without a schema the types are inferred in a further pass.

    Without `sep` it is a tab where the first line holds one, else a comma. Without `encoding` it is UTF-8, or Latin-1 where the
    files hold bytes that aren't UTF-8 (found in a pass over them).
    """
    if sep is None:
        first = spark.read.text(path).limit(1).collect()
        sep = "\t" if first and "\t" in first[0].value else ","
    if encoding is None:
        lost = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
        encoding = "ISO-8859-1" if lost else "UTF-8"
    r = spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
    return (r.schema(schema) if schema else r.option("inferSchema", True)).csv(path)


def _field(line: str, start: int, length: int) -> F.Column:
    return F.trim(F.substring(F.col(line), start, length))


def _listed(lines: str, kind: str) -> F.Column:
    """Atom number (from 1) to value of the property lines `M  CHG` or `M  ISO`: a count and that many pairs of four columns; the last entry of an atom counts."""
    of = F.filter(lines, lambda s: s.startswith(f"M  {kind}"))
    pairs = F.flatten(F.transform(of, lambda s: F.regexp_extract_all(F.substring(s, 10, 4096), F.lit(r"( *\d+ +[-+]?\d+)"), 1)))
    part = lambda x, k: F.get(F.split(F.trim(x), " +"), k).try_cast("int")
    entries = F.transform(pairs, lambda x: F.struct(part(x, F.lit(0)).alias("i"), part(x, F.lit(1)).alias("v")))
    # an array that is read from its end, as a map may not hold a key twice
    return F.reverse(F.filter(entries, lambda e: e["i"].isNotNull() & e["v"].isNotNull()))


def _of(entries: F.Column, i: F.Column) -> F.Column:
    return F.get(F.filter(entries, lambda e: e["i"] == i + 1), F.lit(0))["v"]


def sdf(spark: SparkSession, path: str) -> DataFrame:
    """(name, atoms, bonds, props) of all V2000 records of SDF or MOL files; records are split by $$$$ in the scan.

    Charges are those of the atom block's codes, overruled by `M  CHG`; isotopes those of `M  ISO`, else 0.
    """
    raw = spark.read.option("lineSep", "$$$$").text(path).select(F.regexp_replace("value", r"\r", "").alias("v"))
    lines = F.split("v", "\n")
    # what follows a $$$$ begins with its line's end; a first record may begin with an empty name instead
    lines = F.when(F.coalesce(F.get(lines, F.lit(3)), F.lit("")).contains("V2000"), lines).otherwise(F.slice(lines, F.lit(2), F.size(lines)))
    r = raw.select("v", lines.alias("l")).where((F.size("l") >= 4) & F.element_at("l", 4).contains("V2000"))
    head = F.element_at("l", 4)
    n, m = F.try_to_number(F.trim(F.substring(head, 1, 3)), F.lit("999")).cast("int"), F.try_to_number(F.trim(F.substring(head, 4, 3)), F.lit("999")).cast("int")
    r = r.select("v", "l", n.alias("n"), m.alias("m")).where("n is not null and m is not null and size(l) >= 4 + n + m")
    r = r.withColumn("chg", _listed("l", "CHG")).withColumn("iso", _listed("l", "ISO"))
    num = lambda s, a, k: F.trim(F.substring(s, a, k))
    charge = F.create_map(*[F.lit(x) for kv in _CHARGE.items() for x in kv])
    atoms = F.transform(
        F.slice("l", F.lit(5), F.col("n")),
        lambda s, i: F.struct(
            i.cast("int").alias("idx"), num(s, 32, 3).alias("symbol"), num(s, 1, 10).try_cast("double").alias("x"), num(s, 11, 10).try_cast("double").alias("y"), num(s, 21, 10).try_cast("double").alias("z"),
            F.coalesce(_of(F.col("chg"), i), F.try_element_at(charge, num(s, 37, 3).try_cast("int")), F.lit(0)).alias("formal_charge"),
            F.coalesce(_of(F.col("iso"), i), F.lit(0)).alias("isotope"),
        ),
    )
    bonds = F.transform(
        F.slice("l", F.col("n") + 5, F.col("m")),
        lambda s, i: F.struct(
            i.cast("int").alias("idx"), (num(s, 1, 3).try_cast("int") - 1).alias("a"), (num(s, 4, 3).try_cast("int") - 1).alias("b"), num(s, 7, 3).try_cast("int").alias("kind"), F.coalesce(num(s, 10, 3).try_cast("int"), F.lit(0)).alias("stereo")
        ),
    )
    tag = r"> *<([^>]+)>[^\n]*\n([^\n]*)"
    props = F.map_from_entries(F.arrays_zip(F.regexp_extract_all("v", F.lit(tag), 1).alias("k"), F.regexp_extract_all("v", F.lit(tag), 2).alias("val")))
    return r.select(F.trim(F.element_at("l", 1)).alias("name"), atoms.cast(ATOM).alias("atoms"), bonds.cast(BOND).alias("bonds"), props.alias("props"))


def pdb(spark: SparkSession, path: str) -> DataFrame:
    """Atoms of PDB files: fixed columns of ATOM and HETATM lines; lines without coordinates are skipped."""
    f = lambda a, b: _field("value", a + 1, b - a)
    t = spark.read.text(path).where(F.col("value").rlike("^(ATOM  |HETATM)"))
    element = F.coalesce(F.nullif(f(76, 78), F.lit("")), F.regexp_extract(f(12, 16), "([A-Za-z])", 1))
    a = t.select(
        F.input_file_name().alias("mol_id"), f(6, 11).try_cast("int").alias("serial"), f(12, 16).alias("pdb_name"), f(17, 20).alias("res_name"), f(21, 22).alias("chain_id"), f(22, 26).try_cast("int").alias("res_seq"),
        f(30, 38).try_cast("double").alias("x"), f(38, 46).try_cast("double").alias("y"), f(46, 54).try_cast("double").alias("z"), f(60, 66).try_cast("double").alias("b_factor"), F.initcap(element).alias("symbol"),
        F.col("value").startswith("HETATM").alias("is_hetatm"),
    )
    return a.where("x is not null and y is not null and z is not null")


def pdb_structure_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(mol_id, chain_id, start, end, ss_type) of HELIX and SHEET lines."""
    f = lambda a, b: _field("value", a + 1, b - a)
    t = spark.read.text(path)
    helix = t.where(F.col("value").startswith("HELIX")).select(F.input_file_name().alias("mol_id"), f(19, 20).alias("chain_id"), f(21, 25).try_cast("int").alias("start"), f(33, 37).try_cast("int").alias("end"), F.lit("H").alias("ss_type"))
    sheet = t.where(F.col("value").startswith("SHEET")).select(F.input_file_name().alias("mol_id"), f(21, 22).alias("chain_id"), f(22, 26).try_cast("int").alias("start"), f(33, 37).try_cast("int").alias("end"), F.lit("E").alias("ss_type"))
    return helix.union(sheet).where("start is not null and end is not null")


def pdb_conect(spark: SparkSession, path: str) -> DataFrame:
    """(mol_id, a, b): undirected pairs of serials of CONECT lines."""
    t = spark.read.text(path).where(F.col("value").startswith("CONECT"))
    other = F.explode(F.array(*[_field("value", k, 5) for k in (12, 17, 22, 27)]))
    p = t.select(F.input_file_name().alias("mol_id"), _field("value", 7, 5).try_cast("int").alias("i"), other.alias("j")).withColumn("j", F.col("j").try_cast("int")).where("i is not null and j is not null and i <> j")
    return p.select("mol_id", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()


#: AutoDock types and the element they stand for; other types are an element's symbol.
_AUTODOCK = {"A": "C", "OA": "O", "NA": "N", "SA": "S", "HD": "H", "HS": "H", "HX": "H"}


def pdbqt(spark: SparkSession, path: str) -> DataFrame:
    """The PDB columns with partial_charge, autodock_type and the element of that type; types A, OA, NA and SA are aromatic."""
    f = lambda a, b: _field("value", a + 1, b - a)
    t = spark.read.text(path).where(F.col("value").rlike("^(ATOM  |HETATM)"))
    kind = F.nullif(f(77, 79), F.lit(""))
    table = F.create_map(*[F.lit(x) for kv in _AUTODOCK.items() for x in kv])
    symbol = F.coalesce(F.try_element_at(table, kind), F.initcap(kind), F.upper(F.regexp_extract(f(12, 16), "([A-Za-z])", 1)))
    return t.select(
        F.input_file_name().alias("mol_id"), f(6, 11).try_cast("int").alias("serial"), f(12, 16).alias("pdb_name"), f(17, 20).alias("res_name"), f(21, 22).alias("chain_id"), f(22, 26).try_cast("int").alias("res_seq"), f(30, 38).try_cast("double").alias("x"),
        f(38, 46).try_cast("double").alias("y"), f(46, 54).try_cast("double").alias("z"), F.coalesce(f(70, 76).try_cast("double"), F.lit(0.0)).alias("partial_charge"), kind.alias("autodock_type"), symbol.alias("symbol"), F.coalesce(kind.isin("A", "OA", "NA", "SA"), F.lit(False)).alias("aromatic"),
    ).where("x is not null and y is not null and z is not null")


def pdbqt_branches(spark: SparkSession, path: str) -> DataFrame:
    """(mol_id, a, b, depth): serials of the rotatable bonds of BRANCH lines, smaller first, and how many branches they lie in.

    A file is one row, as the nesting follows its lines.
    """
    words = F.filter(F.transform(F.split("value", "\r?\n"), lambda s: F.split(F.trim(s), r"\s+")), lambda w: w[0].isin("BRANCH", "ENDBRANCH"))
    start = F.struct(F.lit(0).alias("depth"), F.expr("cast(array() as array<struct<a:int,b:int,depth:int>>)").alias("out"))

    def step(acc: F.Column, w: F.Column) -> F.Column:
        a, b = F.get(w, F.lit(1)).try_cast("int"), F.get(w, F.lit(2)).try_cast("int")
        opened = F.struct((acc["depth"] + 1).alias("depth"), F.array_append(acc["out"], F.struct(a.alias("a"), b.alias("b"), (acc["depth"] + 1).alias("depth"))).alias("out"))
        closed = F.struct(F.greatest(acc["depth"] - 1, F.lit(0)).alias("depth"), acc["out"].alias("out"))
        return F.when((w[0] == "BRANCH") & a.isNotNull() & b.isNotNull(), opened).when(w[0] == "ENDBRANCH", closed).otherwise(acc)

    t = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mol_id"), F.aggregate(words, start, step)["out"].alias("o"))
    return t.select("mol_id", F.inline("o")).select("mol_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "depth")


def mol2(spark: SparkSession, path: str) -> DataFrame:
    """(name, atoms, bonds) of all records of MOL2 files; symbols from the SYBYL type, bond kinds as written."""
    raw = spark.read.option("lineSep", "@<TRIPOS>MOLECULE").text(path).where(F.col("value").contains("@<TRIPOS>ATOM")).select(F.regexp_replace("value", r"\r", "").alias("v"))
    part = lambda name: F.filter(F.split(F.regexp_extract("v", rf"(?s)@<TRIPOS>{name}\n(.*?)(?:@<TRIPOS>|$)", 1), "\n"), lambda s: F.length(F.trim(s)) > 0)
    col = lambda s, k: F.get(F.split(F.trim(s), r"\s+"), k)
    atoms = F.transform(part("ATOM"), lambda s, i: F.struct(i.cast("int").alias("idx"), F.regexp_extract(col(s, F.lit(5)), r"^([A-Za-z]+)", 1).alias("symbol"), *[col(s, F.lit(2 + k)).try_cast("double").alias(c) for k, c in enumerate("xyz")], col(s, F.lit(5)).alias("sybyl_type"), col(s, F.lit(8)).try_cast("double").alias("partial_charge")))
    bonds = F.transform(part("BOND"), lambda s, i: F.struct(i.cast("int").alias("idx"), (col(s, F.lit(1)).try_cast("int") - 1).alias("a"), (col(s, F.lit(2)).try_cast("int") - 1).alias("b"), col(s, F.lit(3)).alias("kind")))
    return raw.select(F.trim(F.element_at(F.split(F.regexp_replace("v", r"^\n", ""), "\n"), 1)).alias("name"), atoms.alias("atoms"), bonds.alias("bonds"))


def mmcif_atoms(spark: SparkSession, path: str, model: int | None = 1) -> DataFrame:
    """Rows of the _atom_site loop of mmCIF files: auth_ before label_ columns, alternate location blank, A or 1; '.' and '?' are null."""
    import pandas as pd

    names = ["id", "group_PDB", "type_symbol", "label_atom_id", "auth_atom_id", "label_comp_id", "auth_comp_id", "label_asym_id", "auth_asym_id", "label_seq_id", "auth_seq_id", "label_alt_id", "Cartn_x", "Cartn_y", "Cartn_z", "occupancy", "B_iso_or_equiv", "pdbx_PDB_model_num", "pdbx_formal_charge"]

    def read(batches):  # noqa: ANN001, ANN202
        import re

        for b in batches:
            for mol, text in zip(b["mol_id"], b["value"], strict=True):
                cols, rows, inside = [], [], False
                for line in text.splitlines():
                    s = line.strip()
                    if s.startswith("_atom_site."):
                        cols.append(s.split(".", 1)[1].split()[0])
                        inside = True
                    elif inside and (s.startswith(("#", "loop_", "_", "data_")) or not s):
                        inside = False
                        if rows:
                            break
                    elif inside:
                        v = [x.strip("'\"") for x in re.findall(r"'[^']*'|\"[^\"]*\"|\S+", s)]
                        if len(v) == len(cols):
                            d = dict(zip(cols, v, strict=True))
                            rows.append([mol, *[None if d.get(n) in (".", "?", None) else d[n] for n in names]])
                yield pd.DataFrame(rows, columns=["mol_id", *names])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mol_id"), "value")
    raw = files.mapInPandas(read, "mol_id string, " + ", ".join(f"`{n}` string" for n in names))
    a = raw.select(
        "mol_id", F.col("id").try_cast("int").alias("serial"), F.initcap("type_symbol").alias("symbol"), F.coalesce("auth_atom_id", "label_atom_id").alias("pdb_name"), F.coalesce("auth_comp_id", "label_comp_id").alias("res_name"), F.coalesce("auth_asym_id", "label_asym_id").alias("chain_id"),
        F.coalesce("auth_seq_id", "label_seq_id").try_cast("int").alias("res_seq"), *[F.col(f"Cartn_{c}").try_cast("double").alias(c) for c in "xyz"], F.col("B_iso_or_equiv").try_cast("double").alias("b_factor"), F.coalesce(F.col("pdbx_PDB_model_num").try_cast("int"), F.lit(1)).alias("model"),
        F.coalesce(F.col("pdbx_formal_charge").try_cast("int"), F.lit(0)).alias("formal_charge"), (F.col("group_PDB") == "HETATM").alias("is_hetatm"), "label_alt_id",
    ).where("label_alt_id is null or label_alt_id in ('A', '1')").drop("label_alt_id")
    return a if model is None else a.where(F.col("model") == model)


def cif_categories(spark: SparkSession, path: str) -> DataFrame:
    """(mol_id, block, category, row, item, value): every value of CIF files, of loops and of single items alike.

    Quoted values and texts between semicolon lines are one value; '.' and '?' are null; comments are skipped. A file is read
    whole by one task.
    """
    import pandas as pd

    def read(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(mol, *r) for mol, text in zip(b["mol_id"], b["value"], strict=True) for r in _cif(text)]
            yield pd.DataFrame(rows, columns=["mol_id", "block", "category", "row", "item", "value"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("mol_id"), "value")
    return files.mapInPandas(read, "mol_id string, block string, category string, row int, item string, value string")


def _cif(text: str):  # noqa: ANN202
    """(block, category, row, item, value) of every value of a CIF text."""
    import re

    tokens: list[tuple[str, bool]] = []  # text, and whether it is quoted and so a value whatever it says
    lines = iter(text.splitlines())
    for line in lines:
        if line.startswith(";"):
            part = [line[1:]]
            for more in lines:
                if more.startswith(";"):
                    break
                part.append(more)
            tokens.append(("\n".join(part), True))
            continue
        for m in re.finditer(r"'((?:[^']|'(?=\S))*)'(?=\s|$)|\"((?:[^\"]|\"(?=\S))*)\"(?=\s|$)|(#.*$)|(\S+)", line):
            if m[3] is None:
                tokens.append((m[1] if m[1] is not None else m[2], True) if m[4] is None else (m[4], False))
    block, at, count = None, 0, {}
    plain = lambda i: None if i >= len(tokens) or tokens[i][1] else tokens[i][0]
    value = lambda i: None if not tokens[i][1] and tokens[i][0] in (".", "?") else tokens[i][0]
    special = lambda i: (p := plain(i)) is not None and (p.startswith("_") or p.lower().startswith(("data_", "loop_", "save_")))
    while at < len(tokens):
        p = plain(at)
        if p is not None and p.lower().startswith("data_"):
            block, at, count = p[5:], at + 1, {}
        elif p is not None and p.lower() == "loop_":
            at += 1
            names = []
            while (q := plain(at)) is not None and q.startswith("_"):
                names.append(q[1:])
                at += 1
            k = 0
            while at < len(tokens) and not special(at) and names:
                category, _, item = names[k % len(names)].partition(".")
                yield block, category, k // len(names), item, value(at)
                at, k = at + 1, k + 1
        elif p is not None and p.startswith("_") and at + 1 < len(tokens):
            category, _, item = p[1:].partition(".")
            yield block, category, 0, item, value(at + 1)
            at += 2
        else:
            at += 1


#: Items of a bond record between residues, by the column they give.
_CONN = {
    "conn_type": "conn_type_id", "chain1": "ptnr1_auth_asym_id", "res_name1": "ptnr1_auth_comp_id", "seq1": "ptnr1_auth_seq_id", "atom1": "ptnr1_label_atom_id",
    "chain2": "ptnr2_auth_asym_id", "res_name2": "ptnr2_auth_comp_id", "seq2": "ptnr2_auth_seq_id", "atom2": "ptnr2_label_atom_id",
}


def mmcif_bonds(spark: SparkSession, path: str) -> DataFrame:
    """Bonds between residues of the struct_conn category; a missing atom name is SG, a missing number 0."""
    c = cif_categories(spark, path).where("category = 'struct_conn'")
    g = c.groupBy("mol_id", "block", "row").agg(*[F.max(F.when(F.col("item") == item, F.col("value"))).alias(name) for name, item in _CONN.items()])
    return g.select(
        "mol_id", F.lower("conn_type").alias("conn_type"), *[x for k in "12" for x in (F.coalesce(f"chain{k}", F.lit("")).alias(f"chain{k}"), F.coalesce(f"res_name{k}", F.lit("")).alias(f"res_name{k}"), F.coalesce(F.col(f"seq{k}").try_cast("int"), F.lit(0)).alias(f"seq{k}"), F.coalesce(f"atom{k}", F.lit("SG")).alias(f"atom{k}"))]
    )


def folder(spark: SparkSession, path: str, suffixes: tuple[str, ...] = ("mol2", "sdf", "pdb")) -> DataFrame:
    """(path, suffix, bytes) of the files of a folder and those below it that have one of the suffixes; contents aren't read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(path)
    return f.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("suffix"), F.col("length").alias("bytes"))


READERS = {"smi": smiles_file, "smiles": smiles_file, "csv": csv_file, "sdf": sdf, "mol": sdf, "pdb": pdb, "ent": pdb, "pdbqt": pdbqt, "mol2": mol2, "cif": mmcif_atoms, "mmcif": mmcif_atoms}


def load(spark: SparkSession, path: str) -> DataFrame:
    """By the suffix of the path."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix == "tsv":
        return csv_file(spark, path, "\t")
    if suffix == "gz":
        return load(spark, path[:-3]) if path.endswith(".gz") and not path[:-3].rpartition("/")[2].count(".") else READERS[path[:-3].rsplit(".", 1)[-1].lower()](spark, path)
    if suffix not in READERS:
        raise ValueError(f"no reader for .{suffix}")
    return READERS[suffix](spark, path)
