"""Problem 2: one quantity recorded in different units and scales, brought to nM.

A record's label is the unit as its columns, else its comment, else the assay's description spell it. Records of one entity
(molecule and assay) link the labels they are stated in; from the links the scale and offset between every two labels are
estimated robustly, snapped to a known conversion and propagated from nM through the graph of labels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crucible.runtime import written

# Spellings of the units, in lower case, and their conversion: log10(nM) = sign * x + mass * log10(g/mol) + offset,
# where x is log10 of the number, or the number itself for a logarithm.
SPELLINGS = {
    "M": ("m", "molar", "mol/l"),
    "mM": ("mm", "millimolar", "mmol/l"),
    "uM": ("um", "µm", "μm", "micromolar", "umol/l", "µmol/l", "μmol/l"),
    "nM": ("nm", "nanomolar", "nmol/l"),
    "pM": ("pm", "picomolar", "pmol/l"),
    "ug/mL": ("ug/ml", "µg/ml", "μg/ml", "mcg/ml", "ug.ml-1", "µg.ml-1", "μg.ml-1"),
    "ng/mL": ("ng/ml", "ng.ml-1"),
}
KNOWN = {
    "M": (1, 0, 9), "mM": (1, 0, 6), "uM": (1, 0, 3), "nM": (1, 0, 0), "pM": (1, 0, -3),
    "ug/mL": (1, -1, 6), "ng/mL": (1, -1, 3), "-log10 M": (-1, 0, 9), "log10 M": (1, 0, 9),
}
MISSING = (0.0, -999.0)

#: Texts in the regular expressions that Java and RE2 read alike.
UNIT = r"(nanomolar|micromolar|millimolar|picomolar|molar|[nuµμmp]?mol/[lL]|[nuµμmp]?M|(?:[nuµμ]|mc)g/m[lL]|[nuµμ]g\.m[lL]-1)"
NUMBER = r"([0-9]+(?:[.,][0-9]+)?)(?:\s*[xX×*]\s*10\^?([-+]?[0-9]+)|[eE]([-+]?[0-9]+))?"
STATED = rf"^(?:[A-Za-z ]*?(?:IC ?50|EC ?50|K[id]))?\s*[:=]?\s*{NUMBER}\s*{UNIT}(?:$|[\s.,;)(])"
NAMED = rf"(?:^|(?:^|[\s,;(])(?:in|as|says)\s+|:\s+|\(){UNIT}(?:$|[\s.,;)])"
LOG_TYPE = r"^\s*(p|-\s*log|log)"
LOGS = ("-log10 M", "log10 M")
#: How far a link may miss a power of ten to vote for it (1 percent), and the votes a conversion needs.
VOTE, FEWEST_VOTES = 0.00435, 5


def _group(c: str, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def _canonical(c: Column) -> Column:
    """The unit of a spelling; null for none or an unknown one."""
    low = F.lower(F.trim(c))
    out = F.lit(None).cast("string")
    for unit, names in SPELLINGS.items():
        out = F.when(low.isin(*names), unit).otherwise(out)
    return out


def stated_quantities(activities: DataFrame, assays: DataFrame) -> DataFrame:
    """Adds to every record: number (as stated), label (spelling of its unit or sign of its logarithm), unit, said_by.

    Null, 0 and -999 are missing numbers; a number that stands only in the comment counts, with the comment's unit and a comma
    as decimal comma. Percentages and inhibition have no unit here. said_by is column, comment, assay or type; label and unit
    are null when nothing is said, unit alone when the spelling isn't known. The columns used are activity_id, molecule_ref,
    assay_id, ic50, standard_type, standard_units, activity_comment, mol_weight; others are dropped.
    """
    # the description's unit is worked out once an assay; assays are a dimension that joins by Spark's own size check
    about = assays.select(F.col("assay_id").alias("assay"), _group("description", NAMED, 1).alias("assay_label")).where("assay is not null").dropDuplicates(["assay"])
    a = activities.select("activity_id", "molecule_ref", "assay_id", "ic50", "standard_type", "standard_units", "activity_comment", "mol_weight")
    a = a.join(about, a.assay_id == about.assay, "left").drop("assay")
    kind = F.lower(F.regexp_extract("standard_type", "(?i)" + LOG_TYPE, 1))
    log = F.when(kind == "p", "-log10 M").when(kind.startswith("-"), "-log10 M").when(kind == "log", "log10 M")
    mantissa = F.regexp_replace(_group("activity_comment", STATED, 1), ",", ".").cast("double")
    power = F.coalesce(_group("activity_comment", STATED, 2), _group("activity_comment", STATED, 3)).cast("int")
    own = F.when(F.col("ic50").isin(*MISSING) | F.isnan("ic50"), None).otherwise(F.col("ic50"))
    column = F.nullif(F.nullif(F.trim("standard_units"), F.lit("")), F.lit("-"))
    a = a.select(
        "*", log.alias("log"), own.alias("own"), (mantissa * F.pow(F.lit(10.0), F.coalesce(power, F.lit(0)))).alias("told"), column.alias("column_label"),
        _group("activity_comment", STATED, 4).alias("told_label"), _group("activity_comment", NAMED, 1).alias("comment_label"),
    )
    only_told = F.col("own").isNull() & (F.col("told") > 0)
    log = F.when(only_told, None).otherwise(F.col("log"))
    comment = F.coalesce("told_label", "comment_label")
    label = F.when(only_told, F.coalesce("told_label", "column_label")).otherwise(F.coalesce(log, "column_label", comment, "assay_label"))
    by = F.when(only_told, "comment").when(log.isNotNull(), "type").when(F.col("column_label").isNotNull(), "column").when(comment.isNotNull(), "comment").when(F.col("assay_label").isNotNull(), "assay")
    percent = F.coalesce(F.lower(F.trim("standard_type")) == "inhibition", F.lit(False)) | F.coalesce(F.col("column_label") == "%", F.lit(False))
    number = F.when(only_told, F.col("told")).otherwise(F.col("own"))
    a = a.select("activity_id", "molecule_ref", "assay_id", "mol_weight", number.alias("number"), F.when(~percent, label).alias("label"), F.when(~percent, by).alias("said_by"))
    return a.withColumn("unit", F.when(F.col("label").isin(*LOGS), F.col("label")).otherwise(_canonical(F.col("label"))))


def unit_links(stated: DataFrame) -> DataFrame:
    """(a, b, sign, mass, offset, votes, links): the relations x_a = sign * x_b + mass * log10(weight) + offset that entities vote for.

    x is log10 of the number, or the number of a logarithm. An entity (molecule and assay) has one value a label (its
    smallest), so hot entities are met by partial aggregation and a pair of labels has one link an entity. A link votes for
    the relation of which it misses a whole power of ten by at most VOTE: repeated results agree that well, others fall on one
    by chance only now and then. So a pair's scale and offset are its mode, which outliers and wrongly labelled results don't
    move. Both directions come out.
    """
    x = F.when(F.col("label").isin(*LOGS), F.col("number")).when(F.col("number") > 0, F.log10("number"))
    e = stated.where("label is not null and molecule_ref is not null and assay_id is not null").withColumn("x", x).where("x is not null")
    e = e.groupBy("molecule_ref", "assay_id", "label").agg(F.min("x").alias("x"), F.avg(F.log10(F.when(F.col("mol_weight") > 0, F.col("mol_weight")))).alias("w"))
    e = e.withColumn("of", F.collect_list(F.struct("label", "x", "w")).over(Window.partitionBy("molecule_ref", "assay_id")))  # a row a label: few an entity
    pairs = e.select(F.col("label").alias("a"), F.col("x").alias("xa"), "w", F.explode("of").alias("o")).where(F.col("a") != F.col("o.label"))
    w = F.coalesce("w", "o.w")
    ways = [(s, m) for s in (1, -1) for m in (0, 1, -1)]
    tried = F.array(*[F.struct(F.lit(s).alias("sign"), F.lit(m).alias("mass"), (F.col("xa") - s * F.col("o.x") - (m * w if m else 0)).alias("d")) for s, m in ways])
    near = F.abs(F.col("t.d") - F.round("t.d")) <= VOTE
    got = pairs.select("a", F.col("o.label").alias("b"), F.explode(tried).alias("t")).groupBy("a", "b", "t.sign", "t.mass", F.round("t.d").cast("int").alias("offset")).agg(F.count_if(near).alias("votes"), F.count("*").alias("links"))
    return got.where("votes > 0 and offset is not null")


def propagate(links: DataFrame, anchor: str = "nM", rounds: int = 8) -> DataFrame:
    """(label, sign, mass, shift, votes, against): the conversion to log10 nM of every label that links reach from the anchor.

    In each round every label counts the votes for each known conversion that its links to labels converted so far lead to,
    over all of them; the one of most votes is taken if it has at least FEWEST_VOTES and twice as many as the next. Rounds go
    on until nothing changes. Everything stays a table, as spellings are free text and their number has no bound.
    """
    spark = links.sparkSession
    links = written(links)
    known = F.array(*[F.struct(F.lit(s).alias("sign"), F.lit(m).alias("mass"), F.lit(o).alias("shift")) for s, m, o in sorted(set(KNOWN.values()))])
    start = spark.createDataFrame([(anchor, 1, 0, 0, 0, 0)], "label string, sign int, mass int, shift int, votes long, against long")
    found, before = start, None
    for _ in range(rounds):
        f = found.select(F.col("label").alias("a"), F.col("sign").alias("s"), F.col("mass").alias("m"), F.col("shift").alias("o"))
        to = F.struct((F.col("s") * F.col("sign")).alias("sign"), (F.col("m") + F.col("s") * F.col("mass")).alias("mass"), (F.col("o") + F.col("s") * F.col("offset")).alias("shift"))
        votes = links.where(F.col("b") != anchor).join(f, "a").select(F.col("b").alias("label"), to.alias("to"), "votes").where(F.array_contains(known, F.col("to")))
        votes = votes.groupBy("label", "to").agg(F.sum("votes").alias("votes"))
        best = votes.groupBy("label").agg(F.max(F.struct("votes", "to")).alias("best"), F.sum("votes").alias("all"), F.sort_array(F.collect_list("votes"), False).alias("order"))  # at most one entry a known conversion
        best = best.select("label", "best.to.*", F.col("best.votes").alias("votes"), F.coalesce(F.get("order", F.lit(1)), F.lit(0)).alias("against"))
        found = written(start.union(best.where((F.col("votes") >= FEWEST_VOTES) & (F.col("votes") >= 2 * F.col("against")))))
        state = found.agg(F.count("*"), F.sum(F.xxhash64("label", "sign", "mass", "shift").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return found


def conversion_table(stated: DataFrame, spellings: bool = True) -> DataFrame:
    """(label, unit, sign, mass, shift, source): one row a label that can be converted.

    The conversion that the links lead to holds, source 'links'. Only a label that they don't reach surely enough takes its
    spelling's, source 'spelling', unless spellings is False. unit is the known unit of that conversion; labels of one unit
    have one conversion.
    """
    graph = propagate(unit_links(stated)).select("label", F.struct("sign", "mass", "shift").alias("linked"))
    table = {u: F.struct(*[F.lit(v).alias(n) for n, v in zip(("sign", "mass", "shift"), k, strict=True)]) for u, k in KNOWN.items()}
    spelled = F.lit(None).cast("struct<sign:int,mass:int,shift:int>")
    for u, k in table.items():
        spelled = F.when(F.col("unit") == u, k).otherwise(spelled)
    labels = stated.where("label is not null").groupBy("label").agg(F.first("unit").alias("unit")).join(graph, "label", "left")
    use = F.coalesce("linked", spelled) if spellings else F.col("linked")
    t = labels.select("label", use.alias("c"), F.when(F.col("linked").isNotNull(), "links").otherwise("spelling").alias("source")).where("c is not null")
    name = F.concat(F.lit("10^"), F.col("c.shift"), F.lit(" nM"), F.when(F.col("c.mass") != 0, " by weight").otherwise(""))
    for u, k in table.items():
        log = F.col("label").isin(*LOGS)
        name = F.when((F.col("c") == k) & (log if u in LOGS else ~log), u).otherwise(name)
    return t.select("label", name.alias("unit"), "c.sign", "c.mass", "c.shift", "source")


def to_common_unit(activities: DataFrame, assays: DataFrame, spellings: bool = True) -> DataFrame:
    """(activity_id, molecule_ref, assay_id, unit, said_by, value_nm): every record with its quantity in nM; null where it can't be had.

    Mass per volume without a positive mol_weight, missing numbers, percentages and unknown units have no value. Without
    `spellings` only conversions that the links give are used.
    """
    stated = written(stated_quantities(activities, assays))  # the texts are searched once; links, labels and values read the result
    table = written(conversion_table(stated, spellings)).select("label", F.col("unit").alias("common"), "sign", "mass", "shift")
    s = stated.drop("unit").join(table, "label", "left")  # one row a spelling; Spark checks the size and broadcasts, or splits hot labels
    logarithm = F.col("label").isin(*LOGS)
    weight = F.when(F.col("mass") == 0, F.lit(1.0)).when(F.col("mol_weight") > 0, F.pow("mol_weight", "mass"))
    value = F.when(logarithm, F.pow(F.lit(10.0), F.col("sign") * F.col("number") + F.col("shift"))).when(F.col("number") > 0, F.col("number") * F.pow(F.lit(10.0), F.col("shift")) * weight)
    return s.select("activity_id", "molecule_ref", "assay_id", F.col("common").alias("unit"), "said_by", value.alias("value_nm"))


def same_quantity_pairs(converted: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(activity_id_a, activity_id_b), smaller first: records of one molecule and assay stated in different units with values that differ by at most `tolerance` of the larger.

    Values meet in logarithmic buckets as wide as the tolerance, so a hot molecule and assay is split by value.
    """
    c = converted.where("value_nm > 0 and value_nm < double('infinity') and molecule_ref is not null and assay_id is not null")
    bucket = F.floor(F.log("value_nm") / (-math.log(1 - tolerance) * 1.0001))
    a = c.select("molecule_ref", "assay_id", F.col("activity_id").alias("i"), F.col("unit").alias("u"), F.col("value_nm").alias("v"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = c.select("molecule_ref", "assay_id", F.col("activity_id").alias("j"), F.col("unit").alias("w"), F.col("value_nm").alias("z"), bucket.alias("bucket"))
    close = F.abs(F.col("v") - F.col("z")) <= tolerance * F.greatest("v", "z")
    return a.join(b, ["molecule_ref", "assay_id", "bucket"]).where((F.col("i") < F.col("j")) & (F.col("u") != F.col("w")) & close).select(F.col("i").alias("activity_id_a"), F.col("j").alias("activity_id_b"))


def oracle_sql() -> dict[str, str]:
    """The same in DuckDB, by the spellings alone; 'values' is part of other queries' SQL."""

    def unit(c: str) -> str:
        return "CASE " + " ".join(f"WHEN lower(trim({c})) IN ({', '.join(repr(n) for n in names)}) THEN '{u}'" for u, names in SPELLINGS.items()) + " END"

    factor = " ".join(f"WHEN unit = '{u}' THEN number * pow(10.0, {o})" + (" / CASE WHEN mol_weight > 0 THEN mol_weight END" if m else "") for u, (s, m, o) in KNOWN.items() if "log" not in u)
    base = rf"""WITH d AS (SELECT assay_id, nullif(regexp_extract(description, '{NAMED}', 1), '') AS assay_label FROM assays),
        t AS (SELECT a.*, assay_label, lower(regexp_extract(standard_type, '(?i){LOG_TYPE}', 1)) AS kind, CASE WHEN ic50 NOT IN (0, -999) THEN ic50 END AS own,
            CAST(nullif(replace(regexp_extract(activity_comment, '{STATED}', 1), ',', '.'), '') AS DOUBLE)
                * pow(10.0, coalesce(CAST(nullif(regexp_extract(activity_comment, '{STATED}', 2), '') AS INT), CAST(nullif(regexp_extract(activity_comment, '{STATED}', 3), '') AS INT), 0)) AS told,
            nullif(nullif(trim(standard_units), ''), '-') AS column_label, nullif(regexp_extract(activity_comment, '{STATED}', 4), '') AS told_label,
            nullif(regexp_extract(activity_comment, '{NAMED}', 1), '') AS comment_label FROM activities a LEFT JOIN d USING (assay_id)),
        u AS (SELECT activity_id, molecule_ref, assay_id, mol_weight, own IS NULL AND coalesce(told > 0, false) AS only_told,
            CASE WHEN kind = 'p' OR kind LIKE '-%' THEN '-log10 M' WHEN kind = 'log' THEN 'log10 M' END AS log, own, told, column_label, told_label, comment_label, assay_label,
            coalesce(lower(trim(standard_type)) = 'inhibition', false) OR coalesce(column_label = '%', false) AS percent FROM t),
        l AS (SELECT *, CASE WHEN percent THEN NULL WHEN only_told THEN coalesce(told_label, column_label) ELSE coalesce(log, column_label, told_label, comment_label, assay_label) END AS label,
            CASE WHEN percent THEN NULL WHEN only_told THEN 'comment' WHEN log IS NOT NULL THEN 'type' WHEN column_label IS NOT NULL THEN 'column' WHEN coalesce(told_label, comment_label) IS NOT NULL THEN 'comment' WHEN assay_label IS NOT NULL THEN 'assay' END AS said_by,
            CASE WHEN only_told THEN told ELSE own END AS number FROM u),
        n AS (SELECT *, CASE WHEN label IN ('-log10 M', 'log10 M') THEN label ELSE {unit("label")} END AS unit FROM l),
        c AS (SELECT activity_id, molecule_ref, assay_id, unit, said_by, CASE WHEN unit = '-log10 M' THEN pow(10.0, 9 - number) WHEN unit = 'log10 M' THEN pow(10.0, 9 + number) WHEN NOT number > 0 THEN NULL {factor} END AS value_nm FROM n)"""
    return {
        "values": f"{base} SELECT activity_id, value_nm FROM c",
        "p2_found": f"{base} SELECT a.activity_id AS activity_id_a, b.activity_id AS activity_id_b FROM c a JOIN c b USING (molecule_ref, assay_id) WHERE a.activity_id < b.activity_id AND a.unit <> b.unit AND abs(a.value_nm - b.value_nm) <= 0.01 * greatest(a.value_nm, b.value_nm)",
        "p2_converted": f"{base} SELECT activity_id, unit, said_by, CASE WHEN value_nm IS NOT NULL THEN round(log10(value_nm), 6) END AS log_nm FROM c",
    }
