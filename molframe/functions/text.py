"""Column expressions on names, tags and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the twenty standard residues
ONE_LETTER = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H",
    "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W",
    "TYR": "Y", "VAL": "V",
}

# fixed values: accession syntax of the protein sequence database
ACCESSION = "^([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{2}[0-9]){1,2})$"
MODEL_ID = "^AF-([A-Z0-9]+)-F[0-9]+"


def map_of(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def one_letter(name: Column) -> Column:
    return F.coalesce(F.try_element_at(map_of(ONE_LETTER), F.upper(name)), F.lit("X"))


def residue_number(tag: Column) -> Column:
    """The number of a tag such as 100A or -7; null when it is none."""
    return F.regexp_extract(F.trim(tag), r"^(-?[0-9]+)([A-Za-z]?)$", 1).try_cast("int")


def residue_icode(tag: Column) -> Column:
    return F.regexp_extract(F.trim(tag), r"^(-?[0-9]+)([A-Za-z]?)$", 2)


def letters(k: Column) -> Column:
    """0 -> A, 25 -> Z, 26 -> AA and so on; fourteen letters name any bigint."""
    start = F.struct(k.cast("bigint").alias("rest"), F.lit("").alias("text"))

    def step(acc: Column, _: Column) -> Column:
        rest, text = acc["rest"], acc["text"]
        more = F.struct((F.floor(rest / F.lit(26)) - 1).cast("bigint").alias("rest"), F.concat(F.char(F.lit(65) + F.pmod(rest, F.lit(26))), text).alias("text"))
        return F.when(rest >= 0, more).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["text"])


def normalise_header(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[ _.\-]", ""))


def af_accession(ident: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(ident), MODEL_ID, 1), F.lit(""))


def is_accession(ident: Column) -> Column:
    return F.upper(F.trim(ident)).rlike(ACCESSION)


def source_id(text: Column) -> Column:
    """What an identifier is: kind and upper-cased id, null when it is none we know."""
    t = F.upper(F.trim(text))
    kind = (
        F.when(t.rlike("^[0-9][A-Z0-9]{3}$"), F.lit("pdb"))
        .when(t.rlike("^PDB_[0-9]{5}[A-Z0-9]{3}$"), F.lit("pdb"))
        .when(t.rlike(MODEL_ID), F.lit("model"))
        .when(t.rlike(ACCESSION), F.lit("uniprot"))
    )
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), t.alias("id")))


def wrap_list(items: Column, width: int) -> Column:
    """The first `width` items joined by commas, the rest as a count."""
    shown = F.concat_ws(", ", F.slice(items, 1, width))
    more = F.size(items) - F.lit(width)
    return F.when(more > 0, F.concat(shown, F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(shown)


def clean_number(c: Column) -> Column:
    """NaN and infinities as null."""
    big = F.lit(float("inf"))
    return F.when(F.isnan(c) | (c == big) | (c == -big), F.lit(None)).otherwise(c)


def clean_json(entries: Column) -> Column:
    """A map column of numbers as JSON text, keys in order and non-numbers null."""
    ordered = F.array_sort(F.map_entries(entries))
    tidy = F.transform(ordered, lambda e: F.struct(e["key"].alias("key"), clean_number(e["value"]).alias("value")))
    return F.to_json(F.map_from_entries(tidy), {"ignoreNullFields": "false"})


def feature_text(description: Column, ligand: Column, kind: Column) -> Column:
    """What a feature is called, whole."""
    return F.coalesce(F.nullif(description, F.lit("")), F.nullif(ligand, F.lit("")), kind)


def feature_label(description: Column, ligand: Column, kind: Column, width: int = 40) -> Column:
    """`feature_text` as it is shown, cut to `width`."""
    text = feature_text(description, ligand, kind)
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width - 2), F.lit("…"))).otherwise(text)


def same_name(a: Column, b: Column, shift_a: Column, shift_b: Column) -> Column:
    """Equal names, or numbered names of one kind and mark whose numbers agree once the unmatched elements before
    each are taken off."""
    part = lambda c, g: F.regexp_extract(c, "^([^0-9]*)([0-9]+)([^0-9]*)$", g)
    na, nb = part(a, 2).try_cast("bigint"), part(b, 2).try_cast("bigint")
    alike = (part(a, 1) == part(b, 1)) & (part(a, 3) == part(b, 3)) & (na - shift_a == nb - shift_b)
    return (a == b) | F.coalesce(alike, F.lit(False))


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading quote; numbers are left alone."""
    formula = c.rlike(r"^[=+\-@]") & c.try_cast("double").isNull()
    return F.when(formula, F.concat(F.lit("'"), c)).otherwise(c)
