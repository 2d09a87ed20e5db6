"""User tables, alignments, published tables and text forms."""

import random

import pytest
from pyspark.sql import functions as F

from molframe.operators import chains as H
from molframe.operators import compare as P
from molframe.operators import domains as D
from molframe.operators import superpose as S
from molframe.operators.interactions import parse_selection
from molframe.sources import tables as T


def write(path, text):
    path.write_text(text)
    return str(path)


def test_residue_table_and_crosslinks(spark, tmp_path):
    p = write(tmp_path / "a.csv", "# note\nChain ID,Res Num,score,kind\nA,45,1.5,x\nA,100A,na,y\n")
    rows, column, kind = T.read_residue_table(spark, p)
    assert (column, kind) == ("score", "number")
    assert [(r.chain, r.residue, r.value) for r in rows.collect()] == [("A", "45", "1.5"), ("A", "100A", "na")]
    x = T.read_crosslinks(spark, write(tmp_path / "b.csv", "chain1;residue1;chain2;residue2;distance\nA;1;B;2;12\n")).first()
    assert (x.a_chain, x.a_residue, x.b_chain, x.b_residue, x.span) == ("A", "1", "B", "2", 12.0)


def test_alignments(spark, tmp_path):
    f = T.read_alignment(spark, write(tmp_path / "f.fasta", ">one x\nAC-\nG.\n>two\nACD\nGT\n"))
    assert [(r.row, r.name, r.seq) for r in f.orderBy("row").collect()] == [(1, "one", "AC-G-"), (2, "two", "ACDGT")]
    c = T.read_alignment(spark, write(tmp_path / "c.aln", "CLUSTAL W\n\none  AC-\ntwo  ACD\n     ** \n\none  GT\ntwo  G~\n"))
    assert sorted((r.name, r.seq) for r in c.collect()) == [("one", "AC-GT"), ("two", "ACDG-")]
    assert T.uneven_alignments(c).count() == 0


def test_schema_check_and_text_forms(spark):
    row = [("e", "A", "B", "zz", 3)]
    bad = T.check_schema(spark.createDataFrame(row, "entry string, chain_a string, chain_b string, measure string, contacts bigint"), "interfaces")
    found = {(r.column, r.problem) for r in bad.collect()}
    assert ("measure", "unknown value") in found and ("salt", "missing") in found
    nt = spark.createDataFrame([("e", 1, "G", 4, 0), ("e", 2, "A", None, None), ("e", 3, "A", None, None), ("e", 4, "C", 1, 0)], "entry string, pos int, base string, partner int, level int")
    seq, marks = T.dot_bracket(nt, ["entry"])
    assert (seq.first().body, marks.first().body) == ("GAAC", "(..)")
    assert [r.line for r in T.ct_lines(nt, ["entry"]).orderBy("pos").collect()] == ["1 G 0 2 4 1", "2 A 1 3 0 2", "3 A 2 4 0 3", "4 C 3 0 1 4"]
    with pytest.raises(ValueError):
        T.select_sections({"a": nt}, ["b"])
    with pytest.raises(ValueError):
        parse_selection("chains:A+A")


def test_strays_status_and_mates(spark):
    runs = spark.createDataFrame([("e", "A", 1, "x", 40), ("e", "A", 2, "y", 5), ("e", "A", 3, "x", 10), ("e", "A", 4, "y", 50)], "entry string, chain string, run int, label string, residues int")
    assert sorted((r.label, r.residues) for r in H.no_strays(runs, ["entry", "chain"]).collect()) == [("x", 55), ("y", 50)]
    mark = lambda v: spark.createDataFrame([("e", float(x)) for x in v], "entry string, at double")
    ends = spark.createDataFrame([("e", 400)], "entry string, size int")
    s = H.boundary_status(mark([50, 100, 200]), mark([55, 140, 300]), ends, ["entry"]).first()
    assert (s.found, s.moved, s.missed, s.extra) == (1, 2, 0, 0)
    cols = "entry string, kind string, id string, first int, last int"
    a = spark.createDataFrame([("e", "H", "h1", 1, 20), ("e", "E", "s1", 30, 36)], cols)
    b = spark.createDataFrame([("e", "H", "k1", 1, 9), ("e", "H", "k2", 11, 20), ("e", "E", "t1", 31, 36)], cols)
    al = spark.createDataFrame([("e", i, i) for i in range(1, 41)], "entry string, i int, j int")
    got = {(r.a, r.b, r.status) for r in P.element_mates(a, b, al, ["entry"]).collect()}
    assert got == {("s1", "t1", "mate"), ("h1", "k2", "mate"), ("h1", "k1", "piece")}


def test_superposition_of_a_turned_copy(spark):
    rng = random.Random(1)
    pts = [[rng.uniform(-20, 20) for _ in range(3)] for _ in range(40)]
    df = spark.createDataFrame([("e", i, 40, *p, p[1], -p[0], p[2] + 5) for i, p in enumerate(pts)], "entry string, i int, length int, x double, y double, z double, u double, v double, w double")
    f = S.kabsch(df, ["entry"]).first()
    assert f.rmsd < 1e-4 and abs(f.r[1] - 1) < 1e-9 and abs(f.r[3] + 1) < 1e-9 and abs(f.t.z - 5) < 1e-9
    turn = S.domain_turns(df.withColumn("domain", F.lit("d")), S.kabsch(df, ["entry"]), ["entry"], "domain").first()
    assert turn.turn == 0.0


def test_two_clusters_are_two_domains(spark):
    rng = random.Random(4)
    rows = [("e", "A", k, 45.0 * (k >= 60) + rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(120)]
    df = spark.createDataFrame(rows, "entry string, chain string, pos bigint, x double, y double, z double")
    d, cuts = D.residue_domains(df)
    assert [r.domain for r in d.orderBy("pos").collect()] == [0] * 60 + [1] * 60
    assert cuts.count() == 1 and cuts.first().confidence > 0.9
