"""Structure files as tables. Files are read line by line, so a large one is split over tasks like any text.

Each line gets `idx`: its block's offset in the file plus its rank in the task. Lines of a block are read in order by
one task and a block holds at least one byte a line, so `idx` grows along the file. It needs no shuffle.
"""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.operators.polymers import linked_types
from molframe.plans.ordered import Ordered, block_of
from molframe.session import cut

ROW = (1 << 33) - 1
TOKEN = r"""'(?:[^']|'(?=\S))*'(?=\s|$)|"(?:[^"]|"(?=\S))*"(?=\s|$)|\S+"""


SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
ENDINGS = r"\.[^./]+(\.(gz|bz2|zst|lz4))?$"


def entry_of(paths: str | list[str]) -> Column:
    """The entry of a file: its path below the given folder (the common one of several), without the format's ending.
    So two files of one name in two folders, or `1abc.cif` and `1abc.assembly1.cif`, stay two entries."""
    folders = []
    for p in [paths] if isinstance(paths, str) else paths:
        bare = re.sub(SCHEME, "", p)
        fixed = re.split(r"[*?\[{]", bare)[0]
        is_file = fixed != bare or "." in posixpath.basename(bare.rstrip("/"))
        folders.append(posixpath.dirname(fixed) if is_file else bare.rstrip("/"))
    root = posixpath.commonpath(folders) if all(f.startswith("/") for f in folders) else None
    path = F.regexp_replace(F.col("_metadata.file_path"), SCHEME, "")
    name = F.col("_metadata.file_name")
    below = name if root is None else F.when(path.startswith(root.rstrip("/") + "/"), F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)).otherwise(name)
    return F.regexp_replace(below, ENDINGS, "")


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """entry, idx, value."""
    d = spark.read.text(paths).withColumn(
        "idx", F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit(ROW))
    ).withColumn("entry", entry_of(paths))
    return d.select("entry", "idx", "value")


def _field(a: int, b: int) -> Column:
    return F.trim(F.substring("value", a, b - a + 1))


def _number(a: int, b: int, kind: str = "double") -> Column:
    return _field(a, b).try_cast(kind)


def _element(given: Column, atom: Column) -> Column:
    return F.upper(F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(F.substring(F.regexp_replace(atom, "[^A-Za-z]", ""), 1, 1)))


def _first_model(d: DataFrame, opens: Column) -> DataFrame:
    """Lines before the second line for which `opens` holds: one small row per file, joined back."""
    marks = d.filter(opens).groupBy("entry").agg(F.sort_array(F.collect_list("idx")).alias("_m"))
    stop = marks.select("entry", F.try_element_at("_m", F.lit(2)).alias("_stop"))
    return d.join(stop, "entry", "left").filter(F.col("_stop").isNull() | (F.col("idx") < F.col("_stop"))).drop("_stop")


def _atom_columns() -> list[Column]:
    atom = _field(13, 16)
    return [
        F.col("entry"), _field(22, 22).alias("chain"), _field(22, 22).alias("subchain"), _number(23, 26, "int").alias("seq"),
        _field(27, 27).alias("icode"), _field(18, 20).alias("resname"), atom.alias("atom"), _element(_field(77, 78), atom).alias("elem"),
        _field(17, 17).alias("altloc"), F.col("value").startswith("HETATM").alias("het"), _number(31, 38).alias("x"), _number(39, 46).alias("y"),
        _number(47, 54).alias("z"), _number(61, 66).alias("b"), F.col("idx"),
    ]


def read_pdb(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """ATOM and HETATM records of the first model. `entity_type` is polymer for modified residues bonded into a chain, else null."""
    d = _first_model(lines(spark, paths), F.col("value").startswith("MODEL "))
    end = d.filter(F.trim("value") == "END").groupBy("entry").agg(F.min("idx").alias("_end"))
    d = d.join(end, "entry", "left").filter(F.col("_end").isNull() | (F.col("idx") < F.col("_end")))
    return linked_types(d.filter(F.col("value").rlike("^(ATOM  |HETATM)")).select(*_atom_columns()))


def read_membrane_planes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """centre and half thickness from dummy atoms (N inner, O outer), also past the first END; without both, centre 0
    and the largest height."""
    d = lines(spark, paths).filter(F.col("value").rlike("^(ATOM  |HETATM)")).select(*_atom_columns()).filter("resname = 'DUM'")
    g = d.groupBy("entry").agg(
        F.avg(F.when(F.col("atom") == "N", F.col("z"))).alias("inner"), F.avg(F.when(F.col("atom") == "O", F.col("z"))).alias("outer"),
        F.max(F.abs("z")).alias("top"), F.count(F.lit(1)).alias("dummies"),
    )
    both = F.col("inner").isNotNull() & F.col("outer").isNotNull()
    centre = F.when(both, (F.col("inner") + F.col("outer")) / 2.0).otherwise(0.0)
    half = F.when(both, F.abs(F.col("outer") - F.col("inner")) / 2.0).otherwise(F.col("top"))
    return g.select("entry", centre.alias("centre"), half.alias("half"), "dummies")


# ---------------------------------------------------------------- mmCIF loops
def _clean(t: Column) -> Column:
    """A token's value: unquoted `?` and `.` are null, quotes go."""
    return F.when(t.isin("?", "."), F.lit(None)).otherwise(F.regexp_replace(t, r"^(['\"])(.*)\1$", "$2"))


def _tokens(value: Column) -> Column:
    """Tokens of a line up to a comment; a quoted token keeps its blanks."""
    found = F.regexp_extract_all(value, F.lit(TOKEN), F.lit(0))
    comment = F.array_position(F.transform(found, lambda t: t.startswith("#")), F.lit(True)).cast("int")
    return F.when(comment > 0, F.slice(found, 1, comment - 1)).otherwise(found)


def _cells_of_stream(d: DataFrame, category: str) -> DataFrame:
    """entry, idx, cells of a category from all tokens in order, for files whose rows wrap or hold text blocks.

    A block between lines that begin with `;` is one token. A value belongs to the name before it: in a loop that is the
    last name of the header, and the values' numbers, divided by the columns, give row and column. A last row that is
    short keeps the cells it has."""
    semi = F.col("value").startswith(";")
    # both steps read their rows several times, so each is written once
    d = cut(Ordered(d, ["entry"], ["idx"], block_of(F.col("idx"))).running_sum(semi.cast("bigint"), "_n").done())
    inside = F.col("_n") % 2 == 1
    text = d.filter(inside).groupBy("entry", "_n").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_t"))
    whole = F.array_join(F.transform("_t", lambda t, i: F.when(i == 0, F.substring(t["value"], 2, 1 << 30)).otherwise(t["value"])), "\n")
    text = text.select("entry", F.col("_t")[0]["idx"].alias("idx"), F.lit(0).alias("j"), whole.alias("token"), F.lit("value").alias("is"))
    plain = d.filter(~inside).withColumn("value", F.when(semi, F.substring("value", 2, 1 << 30)).otherwise(F.col("value")))
    plain = plain.select("entry", "idx", F.posexplode(_tokens(F.col("value"))).alias("j", "token"))
    what = F.when(F.col("token").startswith("_"), "name").when(F.lower("token").rlike("^(loop_|data_|save_|global_|stop_)"), "mark").otherwise("value")
    plain = plain.select("entry", "idx", "j", F.when(what == "value", _clean(F.col("token"))).otherwise(F.col("token")).alias("token"), what.alias("is"))
    t = Ordered(text.unionByName(plain), ["entry"], ["idx", "j"], block_of(F.col("idx"))).row_number("t")
    t = cut(t.carry(F.when(F.col("is") != "value", F.struct("t", F.col("token").alias("name"))), "of").done())
    prefix = "_" + category.lstrip("_") + "."
    mine = t.filter(F.col("of.name").startswith(prefix))
    heads = mine.filter("is = 'name'").groupBy("entry").agg(F.array_sort(F.collect_list(F.struct("t", F.substring("token", len(prefix) + 1, 1 << 20).alias("c")))).alias("_h"))
    values = mine.filter("is = 'value'").select("entry", "idx", "token", "of", (F.col("t") - F.col("of.t") - 1).alias("k")).join(heads, "entry")
    single = values.groupBy("entry").agg((F.countDistinct("of.t") > 1).alias("_single"))
    v = values.join(single, "entry")
    n = F.size("_h")
    row = F.when(F.col("_single"), F.lit(0)).otherwise(F.floor(F.col("k") / n)).cast("bigint")
    name = F.when(F.col("_single"), F.substring("of.name", len(prefix) + 1, 1 << 20)).otherwise(F.get(F.col("_h"), (F.col("k") % n).cast("int"))["c"])
    v = v.select("entry", "idx", row.alias("row"), name.alias("c"), "token")
    return v.groupBy("entry", "row").agg(F.min("idx").alias("idx"), F.map_from_entries(F.collect_list(F.struct("c", "token"))).alias("cells")).select("entry", "idx", "cells")


def cif_loop(spark: SparkSession, paths: str | list[str], category: str) -> DataFrame:
    """entry, idx, cells (map of column name to value) of a category, whether it is a loop or single items.

    The header rows say where the loop starts and which column is where; it ends at the next line that opens something.
    Where every row is one line, as archives write atoms, lines are read as they are; entries with text blocks, wrapped
    rows or values on the next line go through the token stream. `?` and `.` are null."""
    d = lines(spark, paths)
    name = F.regexp_extract("value", "^_" + category.lstrip("_") + r"\.(\S+)", 1)
    head = d.withColumn("_c", name).filter("_c <> ''").withColumn("_v", F.regexp_extract("value", r"^\S+\s+(.+)$", 1))
    spans = head.groupBy("entry").agg(
        F.max("idx").alias("_last"), F.array_sort(F.collect_list(F.struct("idx", "_c", "_v"))).alias("_h"), F.max(F.length("_v")).alias("_single"),
        F.min(F.length("_v")).alias("_least"),
    )
    opens = d.filter(F.col("value").rlike(r"^(#|loop_|_|data_|save_)")).join(spans.select("entry", "_last"), "entry")
    stop = opens.filter("idx > _last").groupBy("entry").agg(F.min("idx").alias("_stop"))
    spans = spans.join(stop, "entry", "left")
    body = d.join(spans.filter("_single = 0"), "entry").filter("idx > _last and (_stop is null or idx < _stop)")
    body = body.withColumn("_t", F.transform(_tokens(F.col("value")), _clean))
    odd = d.filter(F.col("value").startswith(";")).select("entry").unionByName(body.filter((F.size("_t") != F.size("_h")) & (F.size("_t") > 0)).select("entry"))
    odd = odd.unionByName(spans.filter("_single > 0 and _least = 0").select("entry")).distinct()
    loop = body.filter(F.size("_t") == F.size("_h")).select("entry", "idx", F.map_from_arrays(F.transform("_h", lambda h: h["_c"]), "_t").alias("cells"))
    first = lambda v: _clean(F.get(_tokens(v), F.lit(0)))
    one = spans.filter("_single > 0").select(
        "entry", F.col("_last").alias("idx"), F.map_from_entries(F.transform("_h", lambda h: F.struct(h["_c"], first(h["_v"])))).alias("cells")
    )
    plain = loop.unionByName(one).join(odd, "entry", "left_anti")
    return plain.unionByName(_cells_of_stream(d.join(odd, "entry", "left_semi"), category))


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _cell(name: str) -> Column:
    return F.try_element_at("cells", F.lit(name))


def read_mmcif_atoms(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The _atom_site loop, first model only; columns are found by the header. `entity_type` comes from the file's entities; where it names
    none, it is polymer for modified residues bonded into a chain, else null."""
    d = cif_loop(spark, paths, "atom_site")
    model = _cell("pdbx_PDB_model_num").try_cast("int")
    first = d.groupBy("entry").agg(F.min(F.struct("idx", model.alias("m")))["m"].alias("_m"))
    d = d.withColumn("_model", model).join(first, "entry").filter(F.col("_model").eqNullSafe(F.col("_m")))
    atom = F.coalesce(_cell("auth_atom_id"), _cell("label_atom_id"))
    num = lambda n: _cell(n).try_cast("double")
    atoms = d.select(
        "entry", F.coalesce(_cell("auth_asym_id"), _cell("label_asym_id")).alias("chain"), _cell("label_asym_id").alias("subchain"),
        F.coalesce(_cell("auth_seq_id"), _cell("label_seq_id")).try_cast("int").alias("seq"), F.coalesce(_cell("pdbx_PDB_ins_code"), F.lit("")).alias("icode"),
        F.coalesce(_cell("auth_comp_id"), _cell("label_comp_id")).alias("resname"), atom.alias("atom"), _element(_cell("type_symbol"), atom).alias("elem"),
        F.coalesce(_cell("label_alt_id"), F.lit("")).alias("altloc"), (_cell("group_PDB") == "HETATM").alias("het"), num("Cartn_x").alias("x"),
        num("Cartn_y").alias("y"), num("Cartn_z").alias("z"), num("B_iso_or_equiv").alias("b"), "idx", _cell("label_entity_id").alias("entity"),
    )
    return linked_types(with_entity_types(spark, atoms, paths))


def with_entity_types(spark: SparkSession, atoms: DataFrame, paths: str | list[str]) -> DataFrame:
    """`atoms` with `entity_type` (polymer, non-polymer, water ...) of mmCIF files; null where the file names none. Atoms that have it stay as they are."""
    if "entity_type" in atoms.columns:
        return atoms
    kinds = cif_loop(spark, paths, "entity").select("entry", _cell("id").alias("entity"), _cell("type").alias("entity_type"))
    return atoms.join(kinds.dropDuplicates(["entry", "entity"]), ["entry", "entity"], "left")


def read_helix_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Deposited helices of mmCIF files: id, chain, first, last."""
    d = cif_loop(spark, paths, "struct_conf").filter(_cell("conf_type_id").startswith("HELX"))
    return d.select(
        "entry", F.coalesce(_cell("pdbx_PDB_helix_id"), _cell("id")).alias("id"), _cell("beg_auth_asym_id").alias("chain"),
        _cell("beg_auth_seq_id").try_cast("int").alias("first"), _cell("end_auth_seq_id").try_cast("int").alias("last"),
    )


def read_pdb_helix_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    d = lines(spark, paths).filter(F.col("value").startswith("HELIX "))
    return d.select("entry", _field(12, 14).alias("id"), _field(20, 20).alias("chain"), _number(22, 25, "int").alias("first"), _number(34, 37, "int").alias("last"))


def read_hydrogen_records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Deposited hydrogen-bond rows between residues."""
    d = cif_loop(spark, paths, "struct_conn").filter(_cell("conn_type_id") == "hydrog")
    side = lambda n, t: [
        _cell(f"ptnr{n}_auth_asym_id").alias(t + "_chain"), _cell(f"ptnr{n}_auth_seq_id").try_cast("int").alias(t + "_seq"),
        F.coalesce(_cell(f"pdbx_ptnr{n}_PDB_ins_code"), F.lit("")).alias(t + "_icode"), _cell(f"ptnr{n}_label_atom_id").alias(t + "_atom"),
    ]
    return d.select("entry", *side(1, "a"), *side(2, "b"), _cell("details").alias("details"))


def read_operators(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """entry, assembly, op, chain (subchain), r (nine numbers), t (three): the generator rows with their operators.

    An operator expression is a list, with ranges; a product of two lists is written (..)(..) and multiplied here."""
    gen = cif_loop(spark, paths, "pdbx_struct_assembly_gen").select(
        "entry", _cell("assembly_id").alias("assembly"), _cell("oper_expression").alias("expr"), F.explode(F.split(_cell("asym_id_list"), ",")).alias("chain")
    )
    mat = [_cell(f"matrix[{i}][{j}]").try_cast("double") for i in (1, 2, 3) for j in (1, 2, 3)]
    shift = [_cell(f"vector[{i}]").try_cast("double") for i in (1, 2, 3)]
    ops = cif_loop(spark, paths, "pdbx_struct_oper_list").select("entry", _cell("id").alias("op"), F.array(*mat).alias("r"), F.array(*shift).alias("t"))
    groups = F.expr(r"regexp_extract_all(if(expr like '(%', expr, concat('(', expr, ')')), '\\(([^)]*)\\)', 1)")
    span = lambda item: F.when(
        item.rlike("^[0-9]+-[0-9]+$"),
        F.transform(F.sequence(F.split(item, "-")[0].cast("int"), F.split(item, "-")[1].cast("int")), lambda v: v.cast("string")),
    ).otherwise(F.array(item))
    one = lambda g: F.flatten(F.transform(F.split(g, ","), lambda i: span(F.trim(i))))
    gen = gen.withColumn("_g", groups).withColumn("a", F.explode(one(F.col("_g")[0])))
    gen = gen.withColumn("b", F.explode(F.when(F.size("_g") > 1, one(F.try_element_at("_g", F.lit(2)))).otherwise(F.array(F.lit(None).cast("string")))))
    left = ops.select("entry", F.col("op").alias("a"), F.col("r").alias("ra"), F.col("t").alias("ta"))
    right = ops.select("entry", F.col("op").alias("b"), F.col("r").alias("rb"), F.col("t").alias("tb"))
    j = gen.join(left, ["entry", "a"]).join(right, ["entry", "b"], "left")
    ra, rb, ta, tb = F.col("ra"), F.col("rb"), F.col("ta"), F.col("tb")
    prod = F.array(*[ra[3 * i] * rb[k] + ra[3 * i + 1] * rb[3 + k] + ra[3 * i + 2] * rb[6 + k] for i in range(3) for k in range(3)])
    vec = F.array(*[ra[3 * i] * tb[0] + ra[3 * i + 1] * tb[1] + ra[3 * i + 2] * tb[2] + ta[i] for i in range(3)])
    single = F.col("b").isNull()
    return j.select("entry", "assembly", F.concat_ws("x", "a", "b").alias("op"), "chain", F.when(single, ra).otherwise(prod).alias("r"), F.when(single, ta).otherwise(vec).alias("t"))


def read_dssp(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows of a secondary-structure program's output after its column header; bends and blanks become '-'."""
    d = lines(spark, paths)
    head = d.filter(F.col("value").rlike(r"^\s+#\s+RESIDUE")).groupBy("entry").agg(F.min("idx").alias("_h"))
    d = d.join(head, "entry").filter("idx > _h").filter(F.substring("value", 14, 1) != "!")
    code = F.substring("value", 17, 1)
    return d.select("entry", _field(12, 12).alias("chain"), _number(6, 10, "int").alias("seq"), _field(11, 11).alias("icode"),
                    F.when(code.isin(" ", "S", "P"), F.lit("-")).otherwise(code).alias("code"), "idx").filter("seq is not null")
