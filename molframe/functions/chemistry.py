"""Fixed chemical values: residue names, sites, rings, sugars. All lists here are small constants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMINO = [
    "ALA", "ARG", "ASN", "ASP", "CYS", "GLN", "GLU", "GLY", "HIS", "ILE", "LEU", "LYS", "MET", "PHE", "PRO", "SER",
    "THR", "TRP", "TYR", "VAL", "MSE", "SEC", "PYL",
]
NUCLEOTIDES = ["A", "C", "G", "U", "I", "T", "DA", "DC", "DG", "DT", "DU", "DI"]
WATER = ["HOH", "DOD", "WAT", "H2O"]

# fixed values: hydrogen-bond sites as residue, atom, role, antecedents, hydrogens, rotating
# (role D donor, A acceptor, B both; residue * any protein residue, # any nucleotide)
SITES = [
    ("*", "N", "D", ["CA"], 1, False),
    ("*", "O", "A", [], 0, False),
    ("*", "OXT", "A", [], 0, False),
    ("ARG", "NE", "D", ["CD", "CZ"], 1, False),
    ("ARG", "NH1", "D", ["CZ"], 2, False),
    ("ARG", "NH2", "D", ["CZ"], 2, False),
    ("LYS", "NZ", "D", ["CE"], 3, True),
    ("ASN", "OD1", "B", ["CG"], 2, False),
    ("ASN", "ND2", "B", ["CG"], 2, False),
    ("GLN", "OE1", "B", ["CD"], 2, False),
    ("GLN", "NE2", "B", ["CD"], 2, False),
    ("HIS", "ND1", "B", ["CG", "CE1"], 1, False),
    ("HIS", "NE2", "B", ["CD2", "CE1"], 1, False),
    ("SER", "OG", "B", ["CB"], 1, True),
    ("THR", "OG1", "B", ["CB"], 1, True),
    ("TYR", "OH", "B", ["CZ"], 1, True),
    ("ASP", "OD1", "A", [], 0, False),
    ("ASP", "OD2", "A", [], 0, False),
    ("GLU", "OE1", "A", [], 0, False),
    ("GLU", "OE2", "A", [], 0, False),
    ("TRP", "NE1", "D", ["CD1", "CE2"], 1, False),
    ("CYS", "SG", "B", ["CB"], 1, True),
    ("MET", "SD", "A", [], 0, False),
    ("#", "OP1", "A", [], 0, False),
    ("#", "OP2", "A", [], 0, False),
    ("#", "OP3", "A", [], 0, False),
    ("#", "O5'", "A", [], 0, False),
    ("#", "O4'", "A", [], 0, False),
    ("#", "O3'", "A", [], 0, False),
    ("#", "O2'", "B", ["C2'"], 1, True),
    ("base-G", "N1", "D", ["C2", "C6"], 1, False),
    ("base-G", "N2", "D", ["C2"], 2, False),
    ("base-G", "O6", "A", [], 0, False),
    ("base-G", "N3", "A", [], 0, False),
    ("base-G", "N7", "A", [], 0, False),
    ("base-A", "N6", "D", ["C6"], 2, False),
    ("base-A", "N1", "A", [], 0, False),
    ("base-A", "N3", "A", [], 0, False),
    ("base-A", "N7", "A", [], 0, False),
    ("base-C", "N4", "D", ["C4"], 2, False),
    ("base-C", "N3", "A", [], 0, False),
    ("base-C", "O2", "A", [], 0, False),
    ("base-U", "N3", "D", ["C2", "C4"], 1, False),
    ("base-U", "N1", "D", ["C2", "C6"], 1, False),
    ("base-U", "O2", "A", [], 0, False),
    ("base-U", "O4", "A", [], 0, False),
]

# fixed values: charged side-chain atoms
CATIONS = {"LYS": ["NZ"], "ARG": ["NE", "NH1", "NH2"], "HIS": ["ND1", "NE2"]}
ANIONS = {"ASP": ["OD1", "OD2"], "GLU": ["OE1", "OE2"]}

# fixed values: aromatic rings
RINGS = {
    "PHE": [["CG", "CD1", "CD2", "CE1", "CE2", "CZ"]],
    "TYR": [["CG", "CD1", "CD2", "CE1", "CE2", "CZ"]],
    "TRP": [["CG", "CD1", "NE1", "CE2", "CD2"], ["CD2", "CE2", "CZ2", "CH2", "CZ3", "CE3"]],
    "HIS": [["CG", "ND1", "CD2", "CE1", "NE2"]],
}
BASE_RINGS = [["N1", "C2", "N3", "C4", "C5", "C6"], ["C4", "C5", "N7", "C8", "N9"]]

# fixed values: base pairs as purine, pyrimidine, bonds, bonds needed, kind
BASE_PAIRS = [
    ("G", "C", [("N1", "N3"), ("O6", "N4"), ("N2", "O2")], 2, "WC"),
    ("I", "C", [("N1", "N3"), ("O6", "N4")], 2, "WC"),
    ("A", "U", [("N1", "N3"), ("N6", "O4")], 2, "WC"),
    ("A", "T", [("N1", "N3"), ("N6", "O4")], 2, "WC"),
    ("G", "U", [("N1", "O2"), ("O6", "N3")], 2, "GU"),
    ("G", "T", [("N1", "O2"), ("O6", "N3")], 2, "GU"),
]

# fixed values: sugars of glycans, and those bound through C2
SUGARS = [
    "NAG", "NDG", "A2G", "NGA", "MAN", "BMA", "GAL", "GLA", "GLC", "BGC", "FUC", "FUL", "SIA", "XYS", "XYP", "GCS",
    "GLB", "SLB", "NGC", "KDN",
]
BOUND_BY_C2 = ["SIA", "SLB", "NGC", "KDN"]

METALS = [
    "LI", "NA", "K", "RB", "CS", "MG", "CA", "SR", "BA", "MN", "FE", "CO", "NI", "CU", "ZN", "CD", "HG", "AL", "GA",
    "PB", "AG", "AU", "PT", "PD", "MO", "W", "V", "Y", "LA", "CE", "SM", "EU", "GD", "TB", "YB",
]

# fixed values: membrane residues
OILY = ["ALA", "ILE", "LEU", "MET", "PHE", "VAL", "TRP", "CYS"]
POLAR = ["LYS", "ARG", "ASP", "GLU", "ASN", "GLN", "HIS"]

# fixed values: hydropathy after Kyte and Doolittle
HYDROPATHY = {
    "ALA": 1.8, "ARG": -4.5, "ASN": -3.5, "ASP": -3.5, "CYS": 2.5, "GLN": -3.5, "GLU": -3.5, "GLY": -0.4,
    "HIS": -3.2, "ILE": 4.5, "LEU": 3.8, "LYS": -3.9, "MET": 1.9, "PHE": 2.8, "PRO": -1.6, "SER": -0.8,
    "THR": -0.7, "TRP": -0.9, "TYR": -1.3, "VAL": 4.2,
}

# fixed values: residues counted as similar in an alignment column
SIMILAR = ["STA", "NEQK", "NHQK", "NDEQ", "QHRK", "MILV", "MILF", "HY", "FYW"]


def is_heavy(elem: Column) -> Column:
    return ~F.coalesce(F.upper(elem).isin("H", "D"), F.lit(False))


def polymer_kind(resname: Column) -> Column:
    """protein, nucleic or null, by the name of a standard residue."""
    return F.when(resname.isin(AMINO), F.lit("protein")).when(resname.isin(NUCLEOTIDES), F.lit("nucleic"))


def is_metal(elem: Column) -> Column:
    return F.upper(elem).isin(METALS)


def hydropathy(resname: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in HYDROPATHY.items() for x in kv])
    return F.coalesce(F.try_element_at(m, resname), F.lit(0.0))


def plddt(b: Column, model_max: Column) -> Column:
    """Confidence per cent: a model whose values end at 1 is read as fractions."""
    return F.when(model_max <= 1.0, b * 100.0).otherwise(b)


def plddt_band(p: Column) -> Column:
    return F.when(p > 90, F.lit("very high")).when(p > 70, F.lit("confident")).when(p > 50, F.lit("low")).otherwise(F.lit("very low"))
