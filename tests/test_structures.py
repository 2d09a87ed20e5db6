"""Structure files to residues, codes and elements, on authored fixtures with known answers."""

import random

from conftest import helix, pdb_line
from pyspark.sql import functions as F

from molframe.operators import assembly as A
from molframe.operators import backbone as K
from molframe.operators import interactions as I
from molframe.sources import structures as X


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def helix_lines(chain="A", name="ALA", start=1, move=(0, 0, 0)):
    out, n = [], 1
    for k, r in enumerate(helix(20)):
        for atom in ("N", "CA", "C", "O"):
            out.append(pdb_line(n, atom, name, chain, start + k, [r[atom][i] + move[i] for i in range(3)]))
            n += 1
    return out


def test_helix_codes_and_element(spark, tmp_path):
    p = write(tmp_path / "hel.pdb", ["MODEL        1", *helix_lines(), "ENDMDL", "MODEL        2", *helix_lines(), "ENDMDL"])
    atoms = K.one_conformer(X.read_pdb(spark, p))
    assert atoms.count() == 80
    r = K.backbone(atoms)
    codes, _ = K.secondary_structure(r)
    text = "".join(x.code for x in codes.orderBy("k").collect())
    assert text == "-" + "H" * 18 + "-"
    el = K.elements(r, codes).collect()
    assert [(e.element, e.kind, e.residues) for e in el] == [("A:2-19", "H", 18)]


def test_order_and_partitions_change_nothing(spark, tmp_path):
    p = write(tmp_path / "hel.pdb", helix_lines())
    atoms = X.read_pdb(spark, p)
    want = sorted((x.k, x.code) for x in K.secondary_structure(K.backbone(K.one_conformer(atoms)))[0].collect())
    rows = atoms.collect()
    random.Random(3).shuffle(rows)
    mixed = spark.createDataFrame(rows, atoms.schema).repartition(7)
    got = sorted((x.k, x.code) for x in K.secondary_structure(K.backbone(K.one_conformer(mixed)))[0].collect())
    assert got == want


def test_altloc_icode_missing_oxygen_and_free_hetero(spark, tmp_path):
    h = helix(4)
    at = lambda k, a: h[k][a]
    lines, n = [], 1
    for k in range(4):
        for a in ("N", "CA", "C", "O"):
            if (k, a) == (1, "O") or (k, a) == (3, "O"):
                continue
            seq, ic = (2, "A") if k == 2 else (k + 1, " ")
            lines.append(pdb_line(n, a, "SER", "A", seq, at(k, a), icode=ic, alt="B" if (k, a) == (0, "CA") else " "))
            n += 1
    lines.append(pdb_line(n, "CA", "SER", "A", 1, at(0, "CA"), alt="C"))
    for a, d in (("N", 0), ("CA", 1), ("C", 2), ("O", 3)):
        lines.append(pdb_line(n, a, "ALA", "A", 90, [40 + d, 0, 0], rec="HETATM"))
    p = write(tmp_path / "x.pdb", lines)
    atoms = K.one_conformer(X.read_pdb(spark, p))
    assert [x.altloc for x in atoms.filter("atom = 'CA' and seq = 1").collect()] == ["B"]
    r = {(x.seq, x.icode): x for x in K.backbone(atoms).collect()}
    assert set(r) == {(1, ""), (2, ""), (2, "A")}  # the last has no O and no successor; the free one is dropped
    built, real = r[(2, "")].o, h[1]["O"]
    assert sum((built[c] - real[i]) ** 2 for i, c in enumerate("xyz")) ** 0.5 < 0.15


def test_cif_loop_finds_columns_by_header(spark, tmp_path):
    head = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_entity_id label_seq_id Cartn_z Cartn_y Cartn_x auth_seq_id auth_asym_id pdbx_PDB_model_num"
    body = ["ATOM 1 O \"O5'\" . G A 1 1 3.0 2.0 1.0 7 X 1", "ATOM 2 C 'C A' ? G A 1 1 3.5 2.5 1.5 7 X 1", "ATOM 3 C CA . G A 1 1 9 9 9 7 X 2"]
    text = ["data_T", "loop_", *["_atom_site." + h for h in head.split()], *body, "#", "_cell.length_a 3"]
    a = X.read_mmcif_atoms(spark, write(tmp_path / "t.cif", text)).orderBy("idx").collect()
    assert [(x.atom, x.chain, x.seq, x.x, x.y, x.z, x.altloc) for x in a] == [("O5'", "X", 7, 1.0, 2.0, 3.0, ""), ("C A", "X", 7, 1.5, 2.5, 3.5, "")]


def test_membrane_planes_past_end(spark, tmp_path):
    lines = [pdb_line(1, "CA", "ALA", "A", 1, [0, 0, 0]), "END", pdb_line(2, "N", "DUM", "A", 2, [0, 0, -14.0], rec="HETATM"), pdb_line(3, "O", "DUM", "A", 3, [0, 0, 16.0], rec="HETATM")]
    m = X.read_membrane_planes(spark, write(tmp_path / "m.pdb", lines)).first()
    assert (m.centre, m.half, m.dummies) == (1.0, 15.0, 2)


def test_salt_limit_is_inclusive_after_snapping(spark):
    rows = []
    for k, d in enumerate((3.999, 4.0, 4.001)):
        rows.append(("e", f"A{k}", 1, "", "LYS", "NZ", "N", 10 * k, 100.0 * k, 0.0, 0.0))
        rows.append(("e", f"B{k}", 1, "", "ASP", "OD1", "O", 10 * k + 1, 100.0 * k + d, 0.0, 0.0))
    atoms = spark.createDataFrame(rows, "entry string, chain string, seq int, icode string, resname string, atom string, elem string, idx int, x double, y double, z double")
    assert sorted(x.distance for x in I.salt_bridges(atoms, "interchain").collect()) == [3.999, 4.0]


def test_assembly_and_coincident_copies(spark):
    rows = [("e", "A", "A", k, float(k), 0.0, 0.0, k) for k in range(10)]
    atoms = spark.createDataFrame(rows, "entry string, chain string, subchain string, seq int, x double, y double, z double, idx int")
    one, turn = [1.0, 0, 0, 0, 1, 0, 0, 0, 1], [-1.0, 0, 0, 0, -1, 0, 0, 0, 1]
    f = lambda v: [float(x) for x in v]
    ops = spark.createDataFrame(
        [("e", "1", "1", "A", f(one), [0.0, 0.0, 0.0]), ("e", "1", "2", "A", f(turn), [0.0, 50.0, 0.0]), ("e", "1", "3", "A", f(one), [0.0, 0.0, 0.2])],
        "entry string, assembly string, op string, chain string, r array<double>, t array<double>",
    )
    built = A.build_assembly(atoms, ops)
    assert sorted(x.chain for x in built.select("chain").distinct().collect()) == ["A", "A2", "A3"]
    kept = A.drop_coincident(built)
    assert sorted(x.chain for x in kept.select("chain").distinct().collect()) == ["A", "A2"]


def test_copies_of_a_trimer(spark):
    rows = [("e", c, i, "", "ALA" if i % 2 else "GLY", k * 100 + i, float(i), float(k), 0.0) for k, c in enumerate("ABC") for i in range(30)]
    r = spark.createDataFrame(rows, "entry string, chain string, seq int, icode string, resname string, idx int, x double, y double, z double")
    assert sorted((x.chain, x.first, x.shift) for x in A.chain_copies(r).collect()) == [("A", "A", 0), ("B", "A", 0), ("C", "A", 0)]


def test_backbone_link_columns(spark, tmp_path):
    lines = helix_lines() + helix_lines(chain="B", move=(0, 60, 0))
    r = K.backbone(K.one_conformer(X.read_pdb(spark, write(tmp_path / "two.pdb", lines))))
    first = r.groupBy("chain").agg(F.count_if(~F.col("prev")).alias("n")).collect()
    assert {x.chain: x.n for x in first} == {"A": 1, "B": 1}


CIF = """data_X
loop_
_entity.id
_entity.type
1 polymer
2 non-polymer
loop_
_pdbx_struct_assembly_gen.assembly_id
_pdbx_struct_assembly_gen.oper_expression
_pdbx_struct_assembly_gen.asym_id_list
1 1 A,B
2 1
;C,D,
_not.a_name
;
3
'1,2' "E ,F" # a comment
_single.name
;two
lines
;
_single.other 'a b'
#
loop_
_atom_site.group_PDB
_atom_site.id
_atom_site.type_symbol
_atom_site.label_atom_id
_atom_site.label_comp_id
_atom_site.label_asym_id
_atom_site.label_entity_id
_atom_site.label_seq_id
_atom_site.Cartn_x
_atom_site.Cartn_y
_atom_site.Cartn_z
ATOM 1 N N SEP A 1 1 0.0 0.0 0.0
ATOM 2 C CA SEP A 1 1 1.5
0.0 0.0
ATOM 3 C C SEP A 1 1 2.0 1.4 0.0
ATOM 4 C CB SEP A 1 1 2.0 -1.4 0.0
HETATM 5 H HB SEP A 1 1 2.5 -1.4 0.0
ATOM 6 C "C1'" PSU B 1 2 9.0 0.0 0.0
ATOM 7 C "C4'" PSU B 1 2 9.0 1.0 0.0
ATOM 8 O "O4'" PSU B 1 2 9.0 2.0 0.0
ATOM 12 P P PSU B 1 2 9.0 3.0 0.0
HETATM 9 N N ALA C 2 . 20.0 0.0 0.0
HETATM 10 C CA ALA C 2 . 21.0 0.0 0.0
HETATM 11 C C ALA C 2 . 22.0 0.0 0.0
#
"""


def test_wrapped_rows_and_text_blocks(spark, tmp_path):
    p = write(tmp_path / "x.cif", CIF.splitlines())
    rows = [r.cells for r in X.cif_loop(spark, p, "pdbx_struct_assembly_gen").orderBy("idx").collect()]
    assert [(r["assembly_id"], r["oper_expression"], r["asym_id_list"]) for r in rows] == [("1", "1", "A,B"), ("2", "1", "C,D,\n_not.a_name"), ("3", "1,2", "E ,F")]
    (one,) = X.cif_loop(spark, p, "single").collect()
    assert one.cells == {"name": "two\nlines", "other": "a b"}
    assert X.read_mmcif_atoms(spark, p).count() == 12


def test_polymers_by_entity_and_atoms(spark, tmp_path):
    p = write(tmp_path / "x.cif", CIF.splitlines())
    atoms = X.with_entity_types(spark, X.read_mmcif_atoms(spark, p), p)
    kinds = {(r.resname, r.kind) for r in I.with_kind(atoms).select("resname", "kind").collect()}
    assert kinds == {("SEP", "protein"), ("PSU", "nucleic"), ("ALA", None)}
    assert {r.atom for r in I.polymer_atoms(atoms).filter("resname = 'SEP'").collect()} == {"N", "CA", "C", "CB"}
    assert {(r.resname, r.heavy) for r in I.molecule_parts(atoms).collect()} == {("ALA", 3)}


def test_a_hydrogen_changes_no_contact(spark, tmp_path):
    rows = [("CA", "C", 0.0), ("CB", "C", 1.5), ("HB", "H", 2.0)]
    lines = [pdb_line(i + 10 * k, a, "ALA", c, 1, (x, 3.5 * k, 0), el=e) for k, c in enumerate("AB") for i, (a, e, x) in enumerate(rows)]
    bare = [x for x in lines if x[76:78].strip() != "H"]
    count = lambda ls, n: I.hydrophobic_contacts(X.read_pdb(spark, write(tmp_path / n, ls)), "interchain").count()
    assert count(lines, "h.pdb") == count(bare, "b.pdb") > 0


def test_one_name_in_two_folders(spark, tmp_path):
    for f in ("a", "b"):
        (tmp_path / f).mkdir()
        write(tmp_path / f / "1abc.pdb", helix_lines())
    write(tmp_path / "a" / "1abc.assembly1.pdb", helix_lines())
    got = {r.entry for r in X.read_pdb(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).select("entry").distinct().collect()}
    assert got == {"a/1abc", "b/1abc", "a/1abc.assembly1"}


def test_g_tetrads_of_guanines_in_a_square(spark):
    from molframe.operators import nucleic as N

    # N1 gives to O6 and N2 to N7 of the next, a quarter turn on
    flat = {"N1": (2.0, 2.0), "N2": (4.0, 4.0), "O6": (2.0, -0.5), "N7": (4.0, -1.5), "N9": (6.0, 0.0), "C8": (6.0, -1.0), "C1'": (7.4, 0.5), "C6": (3.0, -0.5), "C2": (3.5, 3.0), "N3": (5.0, 3.0)}
    def rows(entry, shift, turns):
        out = []
        for seq in range(4):
            for k, (atom, (x, y)) in enumerate(flat.items()):
                for _ in range(seq if seq < turns else 0):
                    x, y = -y, x
                far = 0.0 if seq < turns else 100.0 * seq
                out.append((entry, "A", seq + 1, "", "G", atom, seq * 32 + k, atom[0], x + shift + far, y, 0.0))
        return out
    schema = "entry long, chain string, seq long, icode string, resname string, atom string, idx long, elem string, x double, y double, z double"
    atoms = spark.createDataFrame(rows(1, 0.0, 4) + rows(2, 50.0, 3), schema)
    nts = atoms.groupBy("entry", "chain", "seq", "icode").agg({"idx": "min"}).withColumnRenamed("min(idx)", "idx").selectExpr("*", "'G' AS base")
    got = [(r.entry, r.ring) for r in N.g_tetrads(nts, atoms).collect()]
    # three of four guanines make no ring
    assert got == [(1, [0, 32, 64, 96])]


def modified():
    """Three amino acids with SEP in the middle, three nucleotides with PSU in the middle, ATP and a free SEP beside them."""
    h, lines, n = helix(3), [], 1
    def put(atom, res, chain, seq, xyz, rec="ATOM"):
        nonlocal n
        lines.append(pdb_line(n, atom, res, chain, seq, xyz, rec=rec))
        n += 1
    for k, res in enumerate(("ALA", "SEP", "GLY")):
        for a in ("N", "CA", "C", "O"):
            put(a, res, "A", k + 1, h[k][a], "HETATM" if res == "SEP" else "ATOM")
    sugar = {"P": 0.0, "O4'": 1.5, "C4'": 2.5, "C1'": 3.5, "O3'": 5.0}
    for k, res in enumerate(("A", "PSU", "U")):
        for a, x in sugar.items():
            put(a, res, "B", k + 1, (40 + 6.6 * k + x, 0, 0), "HETATM" if res == "PSU" else "ATOM")
    for a, x in (sugar | {"PA": 0.2}).items():
        if a != "P":
            put(a, "ATP", "B", 101, (40 + x, 30, 0), "HETATM")
    for a, x in sugar.items():
        put(a, "5MC", "B", 102, (40 + x, 60, 0), "HETATM")
    for a in ("N", "CA", "C", "O"):
        put(a, "SEP", "A", 103, [v + 80 for v in h[0][a]], "HETATM")
    return lines


CIF_HEAD = ["data_M", "loop_", *["_atom_site." + c for c in "group_PDB id type_symbol label_atom_id label_comp_id label_asym_id auth_asym_id auth_seq_id Cartn_x Cartn_y Cartn_z".split()]]


def test_modified_residues_are_told_by_their_links(spark, tmp_path):
    lines = modified()
    cif = [" ".join((x[:6].strip(), x[6:11].strip(), x[76:78].strip(), '"' + x[12:16].strip() + '"', x[17:20].strip(), x[21], x[21], x[22:26].strip(), *x[30:54].split())) for x in lines]
    for atoms in (X.read_pdb(spark, write(tmp_path / "m.pdb", lines)), X.read_mmcif_atoms(spark, write(tmp_path / "m.cif", CIF_HEAD + cif))):
        assert atoms.count() == len(lines)
        kinds = {(r.resname, r.seq): r.kind for r in I.with_kind(atoms).select("resname", "seq", "kind").distinct().collect()}
        assert kinds == {("ALA", 1): "protein", ("SEP", 2): "protein", ("GLY", 3): "protein", ("A", 1): "nucleic", ("PSU", 2): "nucleic", ("U", 3): "nucleic", ("ATP", 101): None, ("5MC", 102): None, ("SEP", 103): None}
        assert {(r.resname, r.seq) for r in I.free_atoms(atoms).collect()} == {("ATP", 101), ("5MC", 102), ("SEP", 103)}
