"""Queries on the atom binding: interactions, links, rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions import chemistry as chem
from molframe.functions.geom import snap
from molframe.operators import contacts as C
from molframe.operators import interactions as I
from molframe.registry.base import query, with_

PROT = "(" + ", ".join(f"'{n}'" for n in chem.AMINO) + ")"
NUC = "(" + ", ".join(f"'{n}'" for n in chem.NUCLEOTIDES) + ")"
DIST = "floor(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) * 1000 + 0.5) / 1000 + 0.0"
POLY = f"""pol AS (SELECT *, CASE WHEN resname IN {PROT} THEN 'protein' WHEN resname IN {NUC} THEN 'nucleic' END AS kind
  FROM atm WHERE resname IN {PROT} OR resname IN {NUC})"""
ENDS = """ends AS (SELECT entry, chain, min(idx) AS lo, max(idx) AS hi FROM pol WHERE kind = 'protein' GROUP BY ALL),
head AS (SELECT e.entry, e.chain, h.seq AS hseq, t.seq AS tseq FROM ends e JOIN pol h ON h.idx = e.lo JOIN pol t ON t.idx = e.hi)"""
CHARGED = f"""charged AS (SELECT p.*, CASE WHEN (resname = 'LYS' AND atom = 'NZ') OR (resname = 'ARG' AND atom IN ('NE','NH1','NH2'))
    OR (resname = 'HIS' AND atom IN ('ND1','NE2')) OR (kind = 'protein' AND atom = 'N' AND seq = hseq) THEN 1 ELSE -1 END AS charge
  FROM pol p LEFT JOIN head h ON h.entry = p.entry AND h.chain = p.chain
  WHERE (resname = 'LYS' AND atom = 'NZ') OR (resname = 'ARG' AND atom IN ('NE','NH1','NH2'))
    OR (resname = 'HIS' AND atom IN ('ND1','NE2')) OR (kind = 'protein' AND atom = 'N' AND seq = hseq)
    OR (resname = 'ASP' AND atom IN ('OD1','OD2')) OR (resname = 'GLU' AND atom IN ('OE1','OE2'))
    OR (kind = 'nucleic' AND atom IN ('OP1','OP2')) OR (kind = 'protein' AND atom IN ('O','OXT') AND seq = tseq))"""
SALT = f"""salt AS (SELECT a.entry, a.chain AS a_chain, a.seq AS a_seq, a.atom AS a_atom, b.chain AS b_chain, b.seq AS b_seq,
  b.atom AS b_atom, {DIST} AS distance, CASE WHEN a.resname = 'HIS' AND a.atom <> 'N' THEN 'His if protonated' ELSE '' END AS note
  FROM charged a JOIN charged b ON a.entry = b.entry AND a.charge > 0 AND b.charge < 0
    AND a.chain <> b.chain AND {DIST} <= 4.0)"""
OUT = ["a_chain", "a_seq", "a_atom", "b_chain", "b_seq", "b_atom", "distance", "note"]


@query("salt_bridges", "C5 B7", with_(B.ATM, POLY, ENDS, CHARGED, SALT) + "SELECT * EXCLUDE (entry) FROM salt")
def salt(spark, sf):
    return I.salt_bridges(B.atoms(spark, sf), "interchain").select(*OUT)


SELECTED = SALT.replace("a.chain <> b.chain", "(least(a.chain, b.chain), greatest(a.chain, b.chain)) IN (('0', '1'), ('2', '5'))")


@query("select_partners", "B7", with_(B.ATM, POLY, ENDS, CHARGED, SELECTED) + "SELECT * EXCLUDE (entry) FROM salt")
def selected(spark, sf):
    a = B.atoms(spark, sf)
    sel = "chains:1+0,2+5"
    I.require_chains(a, I.parse_selection(sel))
    return I.salt_bridges(a, sel).select(*OUT)


BONDED = f"""hetero AS (SELECT DISTINCT a.idx FROM pol a JOIN pol b ON a.seq = b.seq AND a.chain = b.chain AND a.atom <> b.atom
  WHERE a.elem = 'C' AND b.elem <> 'C' AND {DIST} <= 2.0),
carbon AS (SELECT * FROM pol WHERE elem = 'C' AND idx NOT IN (SELECT idx FROM hetero))"""
LT = "(a.chain, a.seq, a.atom) < (b.chain, b.seq, b.atom)"
HYDRO = f"""near AS (SELECT a.entry, a.chain AS a_chain, a.seq AS a_seq, a.atom AS a_atom, b.chain AS b_chain, b.seq AS b_seq,
  b.atom AS b_atom, {DIST} AS distance FROM carbon a JOIN carbon b ON a.entry = b.entry AND a.chain <> b.chain AND {LT}
  WHERE NOT (a.kind = 'nucleic' AND b.kind = 'nucleic') AND {DIST} <= 4.0),
hydro AS (SELECT * EXCLUDE (rn), '' AS note FROM (SELECT *, row_number() OVER (PARTITION BY a_chain, a_seq, b_chain, b_seq
  ORDER BY distance, a_atom, b_atom) AS rn FROM near) WHERE rn = 1)"""


@query("hydrophobic_contacts", "C9 F1", with_(B.ATM, POLY, BONDED, HYDRO) + "SELECT * EXCLUDE (entry) FROM hydro")
def hydrophobic(spark, sf):
    return I.hydrophobic_contacts(B.atoms(spark, sf), "interchain").select(*OUT)


@query("disulfides", "C16", with_(B.ATM) + f""" SELECT a.chain AS a_chain, a.seq AS a_seq, b.chain AS b_chain, b.seq AS b_seq, {DIST} AS distance
FROM atm a JOIN atm b ON a.idx < b.idx AND a.entry = b.entry WHERE a.resname = 'CYS' AND b.resname = 'CYS' AND a.atom = 'SG' AND b.atom = 'SG'
AND a.seq <> b.seq AND {DIST} < 6.0""")
def disulfides(spark, sf):
    # the cloud is sparser than a protein: the reach is set so that pairs exist
    return I.disulfides(B.atoms(spark, sf), 6.0).select("a_chain", "a_seq", "b_chain", "b_seq", "distance")


FREE = f"free AS (SELECT * FROM atm WHERE resname NOT IN {PROT} AND resname NOT IN {NUC})"


@query("ligand_contacts", "C18", with_(B.ATM, POLY, FREE) + f""" SELECT a.chain AS ligand_chain, a.seq AS ligand_seq, a.resname AS ligand_resname,
b.chain, b.seq, b.resname, b.kind, min({DIST}) AS distance FROM free a JOIN pol b ON a.entry = b.entry AND {DIST} <= 4.0
WHERE a.elem <> 'ZN' OR ({DIST} <= 3.1 AND b.elem IN ('O', 'N', 'S')) GROUP BY ALL""")
def ligand_contacts(spark, sf):
    return I.ligand_contacts(B.atoms(spark, sf)).drop("entry", "ligand_icode", "icode")


@query("covalent_attachments", "C19", with_(B.ATM, POLY, FREE) + f""" SELECT a.chain AS ligand_chain, a.seq AS ligand_seq,
b.chain, b.seq, min({DIST}) AS distance FROM free a JOIN pol b ON a.entry = b.entry AND {DIST} <= 1.9
WHERE a.elem <> 'ZN' GROUP BY ALL""")
def attachments(spark, sf):
    return I.covalent_attachments(B.atoms(spark, sf)).drop("entry", "ligand_icode", "icode")


@query("molecule_parts", "B10", with_(B.ATM, FREE) + """ SELECT chain, seq, resname, count(*) AS heavy,
 (count(*) = 1 AND max(elem) = 'ZN') AS metal, resname IN ('LIG') AS additive FROM free GROUP BY ALL""")
def parts(spark, sf):
    return I.molecule_parts(B.atoms(spark, sf), ["LIG"]).drop("entry", "icode")


ROLES = "roles(rule, atom, role, ante, h, rot) AS (VALUES " + ", ".join(
    "('{}', '{}', '{}', {}, {}, {})".format(r, a.replace("'", "''"), role, "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in ante) + "]::VARCHAR[]", h, str(rot).lower())
    for r, a, role, ante, h, rot in chem.SITES
) + ")"
SITES = f"""res AS (SELECT chain, seq, kind, resname, list(atom) AS names, min(idx) AS place FROM pol GROUP BY ALL),
carb AS (SELECT chain, seq, x, y, z FROM pol WHERE atom = 'C' AND kind = 'protein'),
before AS (SELECT chain, seq, lag(seq) OVER (PARTITION BY chain ORDER BY place) AS pseq FROM res),
linked AS (SELECT a.chain, a.seq FROM pol a JOIN before w ON w.chain = a.chain AND w.seq = a.seq JOIN carb b ON b.chain = a.chain AND b.seq = w.pseq
  WHERE a.atom = 'N' AND a.kind = 'protein' AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 2.5),
base AS (SELECT chain, seq, CASE WHEN list_contains(names, 'O6') THEN 'base-G' WHEN list_contains(names, 'N6') THEN 'base-A'
  WHEN list_contains(names, 'N4') THEN 'base-C' WHEN list_contains(names, 'O4') THEN 'base-U' END AS rule FROM res WHERE kind = 'nucleic'),
site0 AS (SELECT p.*, r.role, r.ante, r.rule, r.h, r.rot FROM pol p LEFT JOIN base USING (chain, seq) JOIN roles r ON r.atom = p.atom
  AND (r.rule = base.rule OR (p.kind = 'nucleic' AND r.rule = '#') OR (p.kind = 'protein' AND r.rule IN ('*', p.resname)))),
bond AS (SELECT a.idx, list(b.atom) AS near FROM pol a JOIN pol b ON a.chain = b.chain AND a.seq = b.seq AND a.atom <> b.atom AND {DIST} <= 1.7 GROUP BY a.idx),
site1 AS (SELECT s.* EXCLUDE (h, rot), coalesce(near, []) AS near,
  CASE WHEN s.rule = '*' AND s.atom = 'N' AND l.seq IS NULL THEN 3 ELSE h END AS h,
  rot OR (s.rule = '*' AND s.atom = 'N' AND l.seq IS NULL) AS rot
  FROM site0 s LEFT JOIN bond USING (idx) LEFT JOIN linked l ON l.chain = s.chain AND l.seq = s.seq),
site2 AS (SELECT *, role IN ('D', 'B') AND len(list_filter(near, lambda n: NOT list_contains(ante, n))) < h AS donor,
  role IN ('A', 'B') AND NOT (atom LIKE 'N%' AND len(near) >= 3) AS acceptor FROM site1),
ant AS (SELECT s.idx, avg(p.x) AS px, avg(p.y) AS py, avg(p.z) AS pz FROM (SELECT *, unnest(ante) AS an FROM site2) s
  JOIN pol p ON p.chain = s.chain AND p.seq = s.seq AND p.atom = s.an GROUP BY s.idx, len(s.ante) HAVING count(*) = len(s.ante)),
site AS (SELECT s.*, px, py, pz FROM site2 s LEFT JOIN ant USING (idx) WHERE donor OR acceptor)"""


def _gives(d: str, a: str) -> str:
    ante = [f"({d}.p{c} - {d}.{c})" for c in "xyz"]
    acc = [f"({a}.{c} - {d}.{c})" for c in "xyz"]
    dot = " + ".join(f"{p} * {q}" for p, q in zip(ante, acc))
    norm = lambda v: "sqrt(" + " + ".join(f"{c} * {c}" for c in v) + ")"
    cos = f"({dot}) / nullif({norm(ante)} * {norm(acc)}, 0)"
    return f"({d}.donor AND {a}.acceptor AND ({cos} IS NULL OR {cos} <= CASE WHEN {d}.rot THEN 0.5 ELSE 0.0 END + 1e-9))"


HB = f"""hb AS (SELECT a.entry, a.chain AS c1, a.seq AS s1, a.atom AS m1, b.chain AS c2, b.seq AS s2, b.atom AS m2, {DIST} AS distance,
  {_gives('a', 'b')} AS f, {_gives('b', 'a')} AS g FROM site a JOIN site b ON a.entry = b.entry AND a.idx < b.idx AND a.chain <> b.chain
  AND {DIST} <= 3.5 AND {DIST} >= 2.5)"""


@query("hbonds_heavy", "C4", with_(B.ATM, POLY, ROLES, SITES, HB) + """ SELECT CASE WHEN f THEN c1 ELSE c2 END AS a_chain, CASE WHEN f THEN s1 ELSE s2 END AS a_seq,
 CASE WHEN f THEN m1 ELSE m2 END AS a_atom, CASE WHEN f THEN c2 ELSE c1 END AS b_chain, CASE WHEN f THEN s2 ELSE s1 END AS b_seq,
 CASE WHEN f THEN m2 ELSE m1 END AS b_atom, distance, '' AS note FROM hb WHERE f OR g""")
def hbonds(spark, sf):
    return I.hbonds_heavy(B.atoms(spark, sf), "interchain").select(*OUT)


RINGS = "rings(rule, ring, size, atom) AS (VALUES " + ", ".join(
    f"('{n}', {i}, {len(r)}, '{a}')" for n, rs in [*chem.RINGS.items(), ("#", chem.BASE_RINGS)] for i, r in enumerate(rs) for a in r
) + ")"


@query("ring_planes", "C6", with_(B.ATM, POLY, RINGS) + """ SELECT chain, seq, 'ring:' || size AS atom,
 floor(sum(round(x * 1000)::BIGINT)::DOUBLE / count(*) / 1000 * 1000 + 0.5) / 1000 + 0.0 AS x, floor(sum(round(y * 1000)::BIGINT)::DOUBLE / count(*) / 1000 * 1000 + 0.5) / 1000 + 0.0 AS y, floor(sum(round(z * 1000)::BIGINT)::DOUBLE / count(*) / 1000 * 1000 + 0.5) / 1000 + 0.0 AS z
 FROM pol JOIN rings USING (atom) WHERE rule = CASE WHEN kind = 'nucleic' THEN '#' ELSE resname END
 GROUP BY chain, seq, ring, size HAVING count(*) = size""")
def rings(spark, sf):
    r = I.ring_planes(B.atoms(spark, sf))
    return r.select("chain", "seq", "atom", *[snap(F.col(c)).alias(c) for c in "xyz"])


@query("cation_pi", "C7")
def cation_pi(spark, sf):
    return I.cation_pi(B.atoms(spark, sf), "interchain")


@query("pi_stacking", "C8")
def pi_stacking(spark, sf):
    return I.pi_stacking(B.atoms(spark, sf), "interchain")


def _plane_sql() -> str:
    """Rings with centroid and unit normal: the axis of least spread, from the smallest root of the characteristic equation."""
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    mean = ", ".join(f"sum(round({c} * 1000)::BIGINT)::DOUBLE / count(*) / 1000 AS m{c}" for c in "xyz")
    second = ", ".join(f"sum({a} * {b}) AS s{a}{b}" for a, b in pairs)
    spread = ", ".join(f"s{a}{b} - size * m{a} * m{b} AS c{a}{b}" for a, b in pairs)
    row = {k: [f"(c{''.join(sorted(k + c))}{' - low' if k == c else ''})" for c in "xyz"] for k in "xyz"}
    cross = lambda p, q: [f"({p[i]} * {q[j]} - {p[j]} * {q[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]
    ways = [cross(row[a], row[b]) for a, b in ("xy", "xz", "yz")]
    norm = lambda v: "sqrt(" + " + ".join(f"{c} * {c}" for c in v) + ")"
    best = " UNION ALL ".join(f"SELECT entry, chain, seq, kind, ring, mx, my, mz, {v[0]} AS vx, {v[1]} AS vy, {v[2]} AS vz, {norm(v)} AS len FROM ring3" for v in ways)
    return f"""ring0 AS (SELECT entry, chain, seq, kind, ring, size, {mean}, {second} FROM pol JOIN rings USING (atom)
  WHERE rule = CASE WHEN kind = 'nucleic' THEN '#' ELSE resname END GROUP BY entry, chain, seq, kind, ring, size HAVING count(*) = size),
ring1 AS (SELECT *, {spread} FROM ring0),
ring2 AS (SELECT *, (cxx + cyy + czz) / 3 AS q, sqrt(((cxx - (cxx + cyy + czz) / 3) ** 2 + (cyy - (cxx + cyy + czz) / 3) ** 2 + (czz - (cxx + cyy + czz) / 3) ** 2 + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p FROM ring1),
ring3 AS (SELECT *, q + 2 * p * cos(acos(greatest(-1.0, least(1.0, ((cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz)) / (2 * p * p * p)))) / 3 + 2 * pi() / 3) AS low FROM ring2 WHERE p > 0),
plane AS (SELECT entry, chain, seq, kind, mx AS x, my AS y, mz AS z, vx / len AS nx, vy / len AS ny, vz / len AS nz FROM
  (SELECT *, row_number() OVER (PARTITION BY entry, chain, seq, ring ORDER BY len DESC) AS rn FROM ({best})) WHERE rn = 1)"""


def _off(n: str) -> str:
    height = f"((a.x - b.x) * {n}.nx + (a.y - b.y) * {n}.ny + (a.z - b.z) * {n}.nz)"
    return "sqrt(" + " + ".join(f"((a.{c} - b.{c}) - {n}.n{c} * {height}) * ((a.{c} - b.{c}) - {n}.n{c} * {height})" for c in "xyz") + ")"


_SNAP = lambda v: f"floor(({v}) * 1000 + 0.5) / 1000 + 0.0"
_ANGLE = _SNAP("degrees(acos(least(1.0, abs(a.nx * b.nx + a.ny * b.ny + a.nz * b.nz))))")
STACKS = f"""stack AS (SELECT a.entry, a.chain AS a_chain, b.chain AS b_chain FROM plane a JOIN plane b ON a.entry = b.entry AND a.chain < b.chain
  AND NOT (a.kind = 'nucleic' AND b.kind = 'nucleic') AND {DIST} <= 5.5 AND {DIST} > 0
  WHERE ({_ANGLE} <= 30.0 OR {_ANGLE} >= 60.0) AND {_SNAP(f"least({_off('a')}, {_off('b')})")} <= 2.0),
centre AS (SELECT entry, chain, seq, x, y, z FROM pol WHERE resname = 'LYS' AND atom = 'NZ' UNION ALL
  SELECT entry, chain, seq, avg(x), avg(y), avg(z) FROM pol WHERE resname = 'ARG' AND atom IN ('NE', 'NH1', 'NH2') GROUP BY entry, chain, seq HAVING count(*) = 3),
catpi AS (SELECT a.entry, a.chain AS a_chain, b.chain AS b_chain FROM centre a JOIN plane b ON a.entry = b.entry AND a.chain <> b.chain
  AND {DIST} <= 6.0 AND {DIST} > 0 WHERE {_SNAP(_off('b'))} <= 2.0)"""
CA = f"""ca AS (SELECT a.entry, a.chain AS chain_a, b.chain AS chain_b, a.idx AS ia, b.idx AS ib, a.element AS ea, b.element AS eb
  FROM pts a JOIN pts b ON a.entry = b.entry AND a.chain < b.chain AND {DIST} <= 8.0)"""


@query("interfaces", "D2 C1 C2", with_(B.PTS, B.ATM, POLY, ENDS, CHARGED, SALT, BONDED, HYDRO, ROLES, SITES, HB, RINGS, _plane_sql(), STACKS, CA) + """,
face AS (SELECT entry, chain_a, chain_b, count(*) AS contacts, count(DISTINCT ia) AS residues_a, count(DISTINCT ib) AS residues_b,
  count(DISTINCT (ea, eb)) AS element_pairs FROM ca GROUP BY ALL),
every AS (SELECT entry, a_chain, b_chain, 'salt' AS kind FROM salt UNION ALL SELECT entry, a_chain, b_chain, 'hydrophobic' FROM hydro
  UNION ALL SELECT entry, c1, c2, 'hbond' FROM hb WHERE f OR g UNION ALL SELECT entry, a_chain, b_chain, 'stack' FROM stack
  UNION ALL SELECT entry, a_chain, b_chain, 'cation_pi' FROM catpi),
held AS (SELECT entry, least(a_chain::BIGINT, b_chain::BIGINT) AS chain_a, greatest(a_chain::BIGINT, b_chain::BIGINT) AS chain_b, kind FROM every)
SELECT entry, chain_a, chain_b, 'ca' AS measure, coalesce(contacts, 0) AS contacts, coalesce(residues_a, 0) AS residues_a, coalesce(residues_b, 0) AS residues_b,
  coalesce(element_pairs, 0) AS element_pairs, count(*) FILTER (WHERE kind = 'hbond') AS hbond, count(*) FILTER (WHERE kind = 'salt') AS salt,
  count(*) FILTER (WHERE kind = 'stack') AS stack, count(*) FILTER (WHERE kind = 'cation_pi') AS cation_pi,
  count(*) FILTER (WHERE kind = 'hydrophobic') AS hydrophobic
FROM face f FULL JOIN held h USING (entry, chain_a, chain_b) GROUP BY ALL""")
def interfaces(spark, sf):
    number = lambda c: F.col(c).cast("bigint").alias(c)
    held = I.chain_interactions(B.atoms(spark, sf)).select("entry", number("chain_a"), number("chain_b"), "kind", "n")
    return C.interfaces(C.chain_faces(B.points(spark, sf)), held)


@query("recheck_interactions", "C10", with_(B.ATM, POLY, ENDS, CHARGED, SALT) + """ SELECT a_chain, a_seq, a_atom, b_chain, b_seq, b_atom,
 distance + 0.5 AS distance, 'distance differs' AS reason FROM salt WHERE note <> ''""")
def recheck(spark, sf):
    a = B.atoms(spark, sf)
    s = I.salt_bridges(a, "interchain")
    # the noted ones are spoilt on purpose, and only they must be found
    spoilt = s.withColumn("distance", F.when(F.col("note") != "", F.col("distance") + 0.5).otherwise(F.col("distance")))
    return I.recheck_interactions(spoilt, a).select(*OUT[:-1], "reason")


@query("residues_touching", "C2", with_(B.ATM, POLY) + f""" SELECT a.chain AS chain_a, a.seq AS seq_a, b.chain AS chain_b, b.seq AS seq_b,
 count(*) AS atom_pairs, min({DIST}) AS distance FROM pol a JOIN pol b ON a.entry = b.entry AND a.kind = 'nucleic' AND b.kind = 'protein'
 AND {DIST} <= 4.0 GROUP BY ALL""")
def na_contacts(spark, sf):
    from molframe.operators.nucleic import na_contacts as touching

    return touching(B.atoms(spark, sf)).select("chain_a", "seq_a", "chain_b", "seq_b", "atom_pairs", "distance")


@query("polymer_kind", "B9", with_(B.ATM) + f""" SELECT chain, CASE WHEN resname IN {PROT} THEN 'protein' WHEN resname IN {NUC} THEN 'nucleic' ELSE 'none' END AS kind,
 count(DISTINCT seq) AS residues, count(*) AS atoms FROM atm GROUP BY ALL""")
def kinds(spark, sf):
    a = B.atoms(spark, sf).withColumn("kind", F.coalesce(chem.polymer_kind(F.col("resname")), F.lit("none")))
    return a.groupBy("chain", "kind").agg(F.countDistinct("seq").alias("residues"), F.count(F.lit(1)).alias("atoms"))
