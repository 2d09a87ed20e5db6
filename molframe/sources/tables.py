"""User and annotation files, and the published output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, MapType, StringType, StructField, StructType

from molframe.functions.text import guarded
from molframe.operators.userdata import is_empty, number_of
from molframe.plans.ordered import Ordered, block_of
from molframe.sources.structures import lines

SCHEMA_VERSION = 1

# fixed values: header names each role may have, after dropping blanks, _ . - and case
SYNONYMS = {
    "chain": ["chain", "chainid", "chainname", "authasymid"],
    "residue": ["residue", "residuenumber", "resnum", "resno", "resi", "resid", "res", "resseq", "authseqid", "number"],
    "icode": ["icode", "insertioncode", "inscode", "pdbxpdbinscode"],
    "resname": ["resname", "residuename", "aa", "aminoacid", "authcompid"],
    "distance": ["distance", "dist", "length", "span", "maxdistance", "cutoff"],
}


# ---------------------------------------------------------------- user tables
def _table(spark: SparkSession, path: str) -> DataFrame:
    """A delimited file as text cells; the delimiter is the one its header line holds. `row` follows the file."""
    head = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != "")).first()
    if head is None:
        raise ValueError(f"{path}: no rows")
    sep = max("\t;,", key=head[0].count)
    d = spark.read.csv(path, sep=sep, header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return d.withColumn("row", F.monotonically_increasing_id() + 2)


def _role(columns: list[str], role: str, ends: tuple[str, ...] = ("",)) -> str | None:
    plain = {"".join(ch for ch in c.lower() if ch not in " _.-"): c for c in columns}
    for end in ends:
        for name in SYNONYMS[role]:
            if name + end in plain:
                return plain[name + end]
    return None


def read_residue_table(spark: SparkSession, path: str, column: str | None = None) -> tuple[DataFrame, str, str]:
    """(rows, value column, number or category): chain, residue, icode, resname, value as text. The value column is the
    one named, else the first whose every non-empty cell is a number."""
    d = _table(spark, path)
    cols = [c for c in d.columns if c != "row"]
    role = {r: _role(cols, r) for r in ("chain", "residue", "icode", "resname")}
    if role["residue"] is None:
        raise ValueError(f"{path}: no residue column")
    rest = [c for c in cols if c not in role.values()]
    flags = d.agg(*[F.bool_and(is_empty(F.col(f"`{c}`")) | number_of(F.col(f"`{c}`")).isNotNull()).alias(c) for c in rest]).first()
    numeric = [c for c in rest if flags[c]]
    if column is not None:
        value = next((c for c in rest if c == column), None) or next((c for c in rest if c.lower() == column.lower()), None)
    else:
        value = numeric[0] if numeric else None
    if value is None:
        raise ValueError(f"{path}: no value column")
    cell = lambda r: F.coalesce(F.col(f"`{role[r]}`"), F.lit("")) if role[r] else F.lit("")
    out = d.select("row", cell("chain").alias("chain"), cell("residue").alias("residue"), cell("icode").alias("icode"), cell("resname").alias("resname"), F.col(f"`{value}`").alias("value"))
    return out, value, "number" if value in numeric else "category"


def read_crosslinks(spark: SparkSession, path: str) -> DataFrame:
    """a_chain, a_residue, b_chain, b_residue, span from columns numbered 1 and 2 or ended a and b."""
    d = _table(spark, path)
    cols = [c for c in d.columns if c != "row"]
    out = [F.col("row")]
    for end, tags in (("a", ("1", "a")), ("b", ("2", "b"))):
        for role in ("chain", "residue"):
            c = _role(cols, role, tags)
            if c is None:
                raise ValueError(f"{path}: no {role} column for end {end}")
            out.append(F.trim(F.col(f"`{c}`")).alias(f"{end}_{role}"))
    dist = _role(cols, "distance")
    out.append((number_of(F.col(f"`{dist}`")) if dist else F.lit(None).cast("double")).alias("span"))
    return d.select(*out)


def read_domain_list(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace columns: domain, the four levels of its code, cluster levels, length, resolution."""
    d = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    t = F.split(F.trim("value"), r"\s+")
    num = lambda i, kind: F.try_element_at(t, F.lit(i)).try_cast(kind)
    return d.select(
        t[0].alias("domain"), F.concat_ws(".", *[F.try_element_at(t, F.lit(i)) for i in (2, 3, 4, 5)]).alias("superfamily"),
        F.concat_ws(".", *[F.try_element_at(t, F.lit(i)) for i in (2, 3, 4, 5, 6)]).alias("cluster"), F.substring(t[0], 1, 4).alias("entry"),
        F.substring(t[0], 5, 1).alias("chain"), num(11, "int").alias("length"), num(12, "double").alias("resolution"),
    )


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """node, example, name of a node-name list."""
    d = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    return d.select(F.regexp_extract("value", r"^(\S+)", 1).alias("node"), F.regexp_extract("value", r"^\S+\s+(\S+)", 1).alias("example"), F.regexp_extract("value", ":(.*)$", 1).alias("name"))


def read_consurf(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """entry, resname, seq, icode, chain, grade of a grades table; the star of a weak grade is dropped."""
    d = lines(spark, paths)
    plain = r"^\s*\d+\s+\S\s+([A-Z]{3}):?(-?\d+)([A-Za-z]?):(\S+)\s+(-?[\d.]+)\s+(\d)\*?"
    d = d.filter(F.col("value").rlike(plain))
    g = lambda i: F.regexp_extract("value", plain, i)
    return d.select("entry", g(1).alias("resname"), g(2).cast("int").alias("seq"), g(3).alias("icode"), g(4).alias("chain"), g(6).cast("int").alias("grade"))


def read_alignment(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """family, row, name, seq of aligned FASTA, Clustal or Stockholm files, read line by line. Chunks of one name join in
    file order; '.' and '~' become '-'. A row is as long as its alignment, so its chunks are gathered per row."""
    d = lines(spark, paths).withColumnRenamed("entry", "family").withColumn("value", F.rtrim("value"))
    fasta = d.filter(F.col("value").startswith(">")).select("family").distinct().withColumn("_f", F.lit(True))
    d = d.join(fasta, "family", "left")
    name = F.when(F.col("value").startswith(">"), F.regexp_extract("value", r"^>\s*(\S+)", 1))
    f = Ordered(d.filter("_f"), ["family"], ["idx"], block_of(F.col("idx"), 1 << 20)).carry(F.when(name.isNotNull(), F.struct(F.col("idx").alias("at"), name.alias("name"))), "_h").done()
    f = f.filter(~F.col("value").startswith(">")).select("family", F.col("_h.at").alias("at"), F.col("_h.name").alias("name"), "idx", F.regexp_replace("value", r"\s", "").alias("chunk"))
    other = d.filter("_f is null").filter(~F.col("value").rlike(r"^(#|//|CLUSTAL|MUSCLE|PROBCONS|\s|$)"))
    m = r"^(\S+)\s+(\S+)"
    o = other.filter(F.col("value").rlike(m)).select("family", F.regexp_extract("value", m, 1).alias("name"), "idx", F.regexp_extract("value", m, 2).alias("chunk"))
    first = o.groupBy("family", "name").agg(F.min("idx").alias("at"))
    o = o.join(first, ["family", "name"]).select("family", "at", "name", "idx", "chunk")
    rows = f.unionByName(o).groupBy("family", "at", "name").agg(F.array_sort(F.collect_list(F.struct("idx", "chunk"))).alias("c"))
    seq = F.upper(F.translate(F.array_join(F.transform("c", lambda x: x["chunk"]), ""), ".~", "--"))
    ranked = Ordered(rows.withColumn("seq", seq), ["family"], ["at"], block_of(F.col("at"), 1 << 20)).row_number("row").done()
    return ranked.select("family", "row", "name", "seq")


def uneven_alignments(rows: DataFrame) -> DataFrame:
    """Families whose rows are not of one length."""
    return rows.groupBy("family").agg(F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most")).filter("least <> most")


# ---------------------------------------------------------------- annotation documents
_END = StructType([StructField("author_residue_number", IntegerType()), StructField("author_insertion_code", StringType()), StructField("residue_number", IntegerType())])


def read_domain_chopping(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """entry, code, topology, domain, segment, chain, first, last of per-entry domain documents."""
    mapping = StructType([StructField("domain", StringType()), StructField("segment_id", IntegerType()), StructField("chain_id", StringType()), StructField("start", _END), StructField("end", _END)])
    node = StructType([StructField("name", StringType()), StructField("topology", StringType()), StructField("mappings", ArrayType(mapping))])
    schema = MapType(StringType(), StructType([StructField("CATH", MapType(StringType(), node))]))
    d = spark.read.text(paths, wholetext=True).select(F.from_json("value", schema).alias("m"))
    d = d.select(F.explode("m").alias("entry", "v")).select("entry", F.explode("v.CATH").alias("code", "n"))
    d = d.select(F.upper("entry").alias("entry"), "code", "n.topology", F.explode("n.mappings").alias("m"))
    return d.select("entry", "code", "topology", "m.domain", F.col("m.segment_id").alias("segment"), F.col("m.chain_id").alias("chain"),
                    F.col("m.start.author_residue_number").alias("first"), F.col("m.end.author_residue_number").alias("last"))


def read_sifts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """entry, accession, chain, unp_first, unp_last, seq_first, seq_last of per-entry mapping documents."""
    mapping = StructType([StructField("chain_id", StringType()), StructField("unp_start", IntegerType()), StructField("unp_end", IntegerType()), StructField("start", _END), StructField("end", _END)])
    schema = MapType(StringType(), StructType([StructField("UniProt", MapType(StringType(), StructType([StructField("name", StringType()), StructField("mappings", ArrayType(mapping))])))]))
    d = spark.read.text(paths, wholetext=True).select(F.from_json("value", schema).alias("m"))
    d = d.select(F.explode("m").alias("entry", "v")).select("entry", F.explode("v.UniProt").alias("accession", "n")).select(F.upper("entry").alias("entry"), "accession", F.explode("n.mappings").alias("m"))
    return d.select("entry", "accession", F.col("m.chain_id").alias("chain"), F.col("m.unp_start").alias("unp_first"), F.col("m.unp_end").alias("unp_last"),
                    F.col("m.start.residue_number").alias("seq_first"), F.col("m.end.residue_number").alias("seq_last"))


def read_uniprot(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, features, structures) of sequence-database documents."""
    s, i = StringType(), IntegerType()
    F_ = StructField
    pos = StructType([F_("value", i)])
    feature = StructType([F_("type", s), F_("description", s), F_("location", StructType([F_("start", pos), F_("end", pos)])), F_("ligand", StructType([F_("name", s)]))])
    prop = StructType([F_("key", s), F_("value", s)])
    ref = StructType([F_("database", s), F_("id", s), F_("properties", ArrayType(prop))])
    doc = StructType([F_("primaryAccession", s), F_("uniProtkbId", s), F_("sequence", StructType([F_("value", s), F_("length", i)])), F_("features", ArrayType(feature)), F_("uniProtKBCrossReferences", ArrayType(ref))])
    d = spark.read.text(paths, wholetext=True).select(F.from_json("value", doc).alias("d")).select("d.*")
    acc = F.col("primaryAccession").alias("accession")
    entries = d.select(acc, F.col("uniProtkbId").alias("name"), F.col("sequence.value").alias("sequence"), F.col("sequence.length").alias("length"))
    f = d.select(acc, F.explode("features").alias("f")).select("accession", "f.type", "f.description", F.col("f.location.start.value").alias("begin"), F.col("f.location.end.value").alias("end"), F.col("f.ligand.name").alias("ligand"))
    x = d.select(acc, F.explode("uniProtKBCrossReferences").alias("x")).filter("x.database = 'PDB'")
    p = F.map_from_entries(F.transform("x.properties", lambda q: F.struct(q["key"], q["value"])))
    x = x.select("accession", F.col("x.id").alias("entry"), p.alias("p"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    x = x.select("accession", "entry", at("Method").alias("method"), F.regexp_extract(at("Resolution"), r"([\d.]+)", 1).try_cast("double").alias("resolution"), at("Chains").alias("chains"),
                 F.regexp_extract(at("Chains"), r"=(\d+)-", 1).try_cast("int").alias("first"), F.regexp_extract(at("Chains"), r"=\d+-(\d+)", 1).try_cast("int").alias("last"))
    return entries, f, x


# ---------------------------------------------------------------- published tables
# fixed values: column order and types of the published tables (entry comes first in each)
TABLES = {
    "elements": "id string, kind string, chain string, first_seq int, first_icode string, last_seq int, last_icode string, residues int, label string, sheet int, domain string",
    "sheets": "sheet int, strand string, position int, role string, direction int, parent string, closed boolean, barrel_n int, shear int",
    "sheet_pairs": "sheet int, a string, b string, kind string, bridges int",
    "sheet_register": "sheet int, a string, b string, a_chain string, a_seq int, a_icode string, b_chain string, b_seq int, b_icode string",
    "disulfides": "a_chain string, a_seq int, a_icode string, b_chain string, b_seq int, b_icode string, a_element string, b_element string",
    "membrane": "element string, side string, from string, to string, depth_min double, depth_max double, spans_slab boolean, crosses_midplane boolean",
    "ligands": "id string, kind string, name string, codes string, symbol string, chain string, seq int, icode string, additive boolean, attached_to string, contacts int, elements string, nucleotides string",
    "ligand_contacts": "ligand string, kind string, name string, chain string, seq int, icode string, element string",
    "interfaces": "chain_a string, chain_b string, measure string, contacts bigint, ca_pairs bigint, residues_a bigint, residues_b bigint, element_pairs bigint, hbond bigint, salt bigint, stack bigint, cation_pi bigint, hydrophobic bigint",
    "interface_elements": "chain_a string, chain_b string, element_a string, element_b string, ca_pairs bigint, hbond bigint, salt bigint, stack bigint, cation_pi bigint, hydrophobic bigint",
    "nucleotides": "index int, strand int, chain string, seq int, icode string, base string, partner int, bracket string, level int, stem string",
    "base_pairs": "i int, j int, a_chain string, a_seq int, a_icode string, b_chain string, b_seq int, b_icode string, kind string, stem string, level int",
    "interactions": "kind string, a_chain string, a_seq int, a_icode string, a_atom string, b_chain string, b_seq int, b_icode string, b_atom string, distance double, angle double, note string, a_element string, b_element string",
}
ENUMS = {
    ("elements", "kind"): ["H", "E", "G"], ("sheet_pairs", "kind"): ["P", "A"], ("base_pairs", "kind"): ["WC", "GU"],
    ("interfaces", "measure"): ["ca", "atoms", "base_pairs"], ("interactions", "kind"): ["hbond", "salt", "stack", "cation-pi", "hydrophobic"],
}
REQUIRED = {"entry", "kind", "sheet", "strand", "measure", "chain_a", "chain_b", "a", "b"}


def columns(name: str) -> list[tuple[str, str]]:
    if name not in TABLES:
        raise ValueError(f"no table {name!r}; tables are {', '.join(TABLES)}")
    return [("entry", "string"), *[tuple(c.strip().split(" ")) for c in TABLES[name].split(",")]]


def conform(df: DataFrame, name: str) -> DataFrame:
    """`df` in the published shape: fixed order and types, numbers to 0.001, missing columns null."""
    from molframe.functions.geom import snap

    out = []
    for c, t in columns(name):
        v = F.col(f"`{c}`") if c in df.columns else F.lit(None)
        v = v.cast(t)
        out.append((snap(v) if t == "double" else v).alias(c))
    return df.select(*out)


def select_sections(tables: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """The named tables of a dict of lazy frames; an unknown name is an error. Nothing else is computed."""
    unknown = [n for n in names if n not in tables]
    if unknown:
        raise ValueError(f"no section {', '.join(unknown)}; sections are {', '.join(tables)}")
    return {n: tables[n] for n in names}


def csv_cells(df: DataFrame) -> DataFrame:
    """All cells as text: null empty, booleans true or false, formula-like text guarded."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        text = guarded(c) if isinstance(f.dataType, StringType) else c.cast("string")
        out.append(F.coalesce(text, F.lit("")).alias(f.name))
    return df.select(*out)


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table under its own folder, in parquet or CSV."""
    for name, df in tables.items():
        shaped = conform(df, name) if name in TABLES else df
        if fmt == "csv":
            csv_cells(shaped).write.mode("overwrite").csv(f"{folder}/{name}", header=True, emptyValue="")
        else:
            shaped.write.mode("overwrite").parquet(f"{folder}/{name}")


def check_schema(df: DataFrame, name: str) -> DataFrame:
    """column, problem, rows: missing or extra columns, wrong types, nulls where none may be, unknown enum values."""
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    fixed, aggs = [], []
    for c, t in columns(name):
        if c not in have:
            fixed.append((c, "missing"))
        elif have[c] != t:
            fixed.append((c, f"type {have[c]}, not {t}"))
        else:
            if c in REQUIRED:
                aggs.append((c, "null", F.col(f"`{c}`").isNull()))
            if (name, c) in ENUMS:
                aggs.append((c, "unknown value", ~F.col(f"`{c}`").isin(ENUMS[(name, c)])))
    fixed += [(c, "not in the table") for c in have if c not in dict(columns(name))]
    rows = [F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), F.count_if(cond).alias("rows")) for c, p, cond in aggs]
    rows += [F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem"), F.count(F.lit(1)).alias("rows")) for c, p in fixed]
    if not rows:
        return df.sparkSession.createDataFrame([], "column string, problem string, rows bigint")
    one = df.agg(F.array(*rows).alias("v")).select(F.explode("v").alias("v")).select("v.*")
    return one.filter((F.col("rows") > 0) | F.col("problem").isin("missing", "not in the table") | F.col("problem").startswith("type"))


def entry_documents(tables: dict[str, DataFrame], order: dict[str, list[str]], part: int = 4096) -> DataFrame:
    """entry, section, part, body: JSON arrays of each section's rows in order, in parts of at most `part` rows, so that
    a very large entry is many rows. A section's parts one after another are the section."""
    out = None
    for name in sorted(tables):
        df = tables[name]
        keys = order[name]
        fields = sorted(c for c in df.columns if c != "entry")
        numeric = dict(df.dtypes)[keys[0]] in ("int", "bigint")
        block = block_of(F.col(keys[0])) if numeric else F.xxhash64(F.lit(0))
        o = Ordered(df, ["entry"], keys, block).row_number("_n").done()
        r = o.withColumn("part", F.floor((F.col("_n") - 1) / part).cast("int"))
        g = r.groupBy("entry", "part").agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*[F.col(f) for f in fields]).alias("v")))).alias("rows"))
        d = g.select("entry", F.lit(name).alias("section"), "part", F.to_json(F.transform("rows", lambda x: x["v"]), {"ignoreNullFields": "false"}).alias("body"))
        out = d if out is None else out.unionByName(d)
    return out


def dot_bracket(nts: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(sequence parts, bracket parts) of nucleotides (group, pos from 1, base, partner, level)."""
    from molframe.operators.nucleic import bracket, ordered_text

    d = nts.withColumn("mark", bracket(F.when(F.col("partner").isNotNull(), F.col("level")), F.col("partner") > F.col("pos")))
    return ordered_text(d, group, "pos", "base", ""), ordered_text(d, group, "pos", "mark", "")


def bpseq_lines(nts: DataFrame) -> DataFrame:
    """One line per nucleotide: place, base, partner (0 for none)."""
    return nts.withColumn("line", F.concat_ws(" ", "pos", "base", F.coalesce("partner", F.lit(0))))


def ct_lines(nts: DataFrame, group: list[str]) -> DataFrame:
    """One line per nucleotide: place, base, previous, next (0 at the end), partner, place."""
    n = nts.groupBy(*group).agg(F.max("pos").alias("_n"))
    nxt = F.when(F.col("pos") == F.col("_n"), F.lit(0)).otherwise(F.col("pos") + 1)
    return nts.join(n, group).withColumn("line", F.concat_ws(" ", "pos", "base", F.col("pos") - 1, nxt, F.coalesce("partner", F.lit(0)), "pos")).drop("_n")
