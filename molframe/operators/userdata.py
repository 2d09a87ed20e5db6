"""User tables joined to residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from molframe.functions.geom import Vec, dist, snap
from molframe.functions.text import one_letter, residue_icode, residue_number

SPAN = 30.0
EMPTY = ["", "na", "n/a", "nan", "none", "null"]  # fixed values: cells that hold no value
KEY = ["chain", "seq", "icode"]


def is_empty(cell: Column) -> Column:
    return cell.isNull() | F.lower(F.trim(cell)).isin(EMPTY)


def number_of(cell: Column) -> Column:
    return F.trim(cell).try_cast("double")


def crosslink_lengths(links: DataFrame, residues: DataFrame, span: float = SPAN) -> DataFrame:
    """CA-CA distance of each link (a_, b_ residue keys, optional span) and whether it exceeds its span."""
    side = lambda t: residues.select("entry", *[F.col(k).alias(f"{t}_{k}") for k in KEY], *[F.col(c).alias(f"_{t}{c}") for c in "xyz"])
    j = links.join(side("a"), ["entry", *[f"a_{k}" for k in KEY]], "left").join(side("b"), ["entry", *[f"b_{k}" for k in KEY]], "left")
    v = lambda t: Vec(*[F.col(f"_{t}{c}") for c in "xyz"])
    d = snap(dist(v("a"), v("b")))
    return j.select(*links.columns, d.alias("distance"), (d > F.coalesce("span", F.lit(span))).alias("over_span"))


def expand_copies(rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Rows with `on_chain`: the chain itself, or else every assembly copy named after it (A -> A1, A2), each copy
    going to the longest named chain its name is followed by digits after. `chains`: entry, chain of the structure."""
    named = rows.select("entry", "chain").distinct()
    own = chains.select("entry", F.col("chain").alias("on_chain"))
    direct = named.join(own, (named["entry"] == own["entry"]) & (named["chain"] == own["on_chain"])).select(named["entry"], "chain", "on_chain")
    # every prefix of a copy's name that leaves only digits, longest named one first
    stems = own.withColumn("cut", F.explode(F.sequence(F.lit(1), F.greatest(F.length("on_chain") - 1, F.lit(1)))))
    stems = stems.withColumn("chain", F.expr("substring(on_chain, 1, cut)")).withColumn("rest", F.expr("substring(on_chain, cut + 1)"))
    stems = stems.filter(F.col("rest").rlike("^[0-9]+$")).join(named, ["entry", "chain"], "left_semi")
    stems = stems.join(named.select("entry", F.col("chain").alias("on_chain")), ["entry", "on_chain"], "left_anti")
    owner = stems.groupBy("entry", "on_chain").agg(F.max_by("chain", "cut").alias("chain"))
    there = direct.unionByName(owner.select("entry", "chain", "on_chain"))
    return rows.join(there, ["entry", "chain"], "left")


def join_user_values(rows: DataFrame, residues: DataFrame) -> DataFrame:
    """Every row of a user table (entry, row, chain, residue, icode, resname, value as text) with the residue it names
    and either its number or the reason it is not used.

    Reasons, first that holds: no chain, no residue, name differs, given twice, not finite."""
    chains = residues.select("entry", "chain").distinct()
    r = expand_copies(rows, chains)
    tag_icode = residue_icode(F.col("residue"))
    given = F.when(F.trim("icode").isin(".", "?"), F.lit("")).otherwise(F.coalesce(F.trim("icode"), F.lit("")))
    r = r.withColumn("_seq", residue_number(F.col("residue"))).withColumn(
        "_icode", F.when(tag_icode == "", given).when(given == "", tag_icode)
    )
    res = residues.select("entry", F.col("chain").alias("on_chain"), F.col("seq").alias("_seq"), F.col("icode").alias("_icode"), F.col("resname").alias("_name"))
    j = r.join(res, ["entry", "on_chain", "_seq", "_icode"], "left")
    want = F.upper(F.trim("resname"))
    named = F.when(F.length(want) == 1, want == one_letter(F.col("_name"))).otherwise(want == F.upper("_name"))
    differs = (F.coalesce(want, F.lit("")) != "") & ~named
    num = number_of(F.col("value"))
    inf = F.lit(float("inf"))
    bad = ~is_empty(F.col("value")) & (num.isNull() | F.isnan(num) | (num == inf) | (num == -inf))
    j = j.withColumn("_why", F.when(F.col("on_chain").isNull(), F.lit("no chain")).when(F.col("_name").isNull(), F.lit("no residue"))
                     .when(differs, F.lit("name differs"))).withColumn("_bad", bad)
    key = ["entry", "on_chain", "_seq", "_icode"]
    first = j.filter(F.col("_why").isNull() & ~F.col("_bad")).groupBy(*key).agg(F.min("row").alias("_first"))
    j = j.join(first, key, "left")
    why = F.coalesce(F.col("_why"), F.when(F.col("row") > F.col("_first"), F.lit("given twice")), F.when(F.col("_bad"), F.lit("not finite")))
    value = F.when(why.isNull() & ~is_empty(F.col("value")), num)
    return j.select("entry", "row", F.col("on_chain").alias("chain"), F.col("_seq").alias("seq"), F.col("_icode").alias("icode"),
                    value.alias("value"), why.alias("reason"))
