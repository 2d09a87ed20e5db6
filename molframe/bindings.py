"""The driver's tables read as points, chains, alignments, edges, segments, runs, campaigns and atoms.

Every binding covers its whole table. Each has a twin in SQL, so that a query and its oracle start from equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from molframe.functions.geom import snap


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _dim(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


# ---------------------------------------------------------------- points
def points(spark: SparkSession, sf: str, scale: float = 100.0) -> DataFrame:
    """entry, chain, idx, element, x, y, z: a cloud of residues; an element is eight residues in a row of a chain."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.lit(0).cast("bigint").alias("entry"), F.col("label").cast("bigint").alias("chain"),
        F.col("vec_id").alias("idx"), F.floor(F.col("vec_id") / 8).cast("bigint").alias("element"),
        *[snap(_dim(i) * scale).alias(n) for i, n in enumerate("xyz")],
    )


PTS = """pts AS (SELECT 0::BIGINT AS entry, label::BIGINT AS chain, vec_id AS idx,
  floor(vec_id / 8.0)::BIGINT AS element,
  floor(embedding[1]::DOUBLE * 100 * 1000 + 0.5) / 1000 + 0.0 AS x,
  floor(embedding[2]::DOUBLE * 100 * 1000 + 0.5) / 1000 + 0.0 AS y,
  floor(embedding[3]::DOUBLE * 100 * 1000 + 0.5) / 1000 + 0.0 AS z FROM embeddings)"""


def moved_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points with a second place each (u, v, w): the next three numbers as a small displacement."""
    e = table(spark, sf, "embeddings")
    p = points(spark, sf).join(
        e.select(F.col("vec_id").alias("idx"), *[snap(_dim(i) * 10.0).alias(f"d{i}") for i in (3, 4, 5)]), "idx"
    )
    return p.select(
        "entry", "chain", "idx", "element", "x", "y", "z",
        *[(F.col(n) + F.col(d)).alias(m) for n, d, m in zip("xyz", ("d3", "d4", "d5"), "uvw")],
    )


MOVED = """moved AS (SELECT p.*, x + (floor(e.embedding[4]::DOUBLE * 10 * 1000 + 0.5) / 1000 + 0.0) AS u,
  y + (floor(e.embedding[5]::DOUBLE * 10 * 1000 + 0.5) / 1000 + 0.0) AS v,
  z + (floor(e.embedding[6]::DOUBLE * 10 * 1000 + 0.5) / 1000 + 0.0) AS w
  FROM pts p JOIN embeddings e ON e.vec_id = p.idx)"""

# residues of the atom binding, with their heavy atoms in order
RESIDUES = [
    ("ALA", "N CA C O CB"),
    ("LEU", "N CA C O CB CG CD1 CD2"),
    ("PHE", "N CA C O CB CG CD1 CD2 CE1 CE2 CZ"),
    ("LYS", "N CA C O CB CG CD CE NZ"),
    ("ARG", "N CA C O CB CG CD NE CZ NH1 NH2"),
    ("ASP", "N CA C O CB CG OD1 OD2"),
    ("GLU", "N CA C O CB CG CD OE1 OE2"),
    ("HIS", "N CA C O CB CG ND1 CD2 CE1 NE2"),
    ("SER", "N CA C O CB OG"),
    ("CYS", "N CA C O CB SG"),
    ("A", "P OP1 OP2 C1' N9 C8 N7 C5 C6 N6 N1 C2 N3 C4"),
    ("C", "P OP1 OP2 C1' N1 C2 O2 N3 C4 N4 C5 C6"),
    ("G", "P OP1 OP2 C1' N9 C8 N7 C5 C6 O6 N1 C2 N2 N3 C4"),
    ("U", "P OP1 OP2 C1' N1 C2 O2 N3 C4 O4 C5 C6"),
    ("ZN", "ZN"),
    ("LIG", "C1 C2 O1 N1"),
]
OFFSET = 20.0


def atoms(spark: SparkSession, sf: str) -> DataFrame:
    """A heavy-atom table from every vector: the residue sits at its point, atoms at offsets read from the vector."""
    e = table(spark, sf, "embeddings")
    names = F.array(*[F.lit(n) for n, _ in RESIDUES])
    lists = F.array(*[F.array(*[F.lit(a) for a in atoms_.split()]) for _, atoms_ in RESIDUES])
    kind = F.pmod(F.col("vec_id"), F.lit(len(RESIDUES))).cast("int") + 1
    r = e.select(
        F.lit(0).cast("bigint").alias("entry"), F.col("label").cast("string").alias("chain"),
        F.col("vec_id").alias("seq"), F.element_at(names, kind).alias("resname"),
        F.element_at(lists, kind).alias("names"), "embedding",
    )
    a = r.select("entry", "chain", "seq", "resname", "embedding", F.posexplode("names").alias("k", "atom"))
    off = lambda i: F.when(F.col("k") == 0, F.lit(0.0)).otherwise(F.col("embedding")[F.col("k") * 3 + i].cast("double") * OFFSET)
    return a.select(
        "entry", "chain", "seq", F.lit("").alias("icode"), "resname", "atom", (F.col("seq") * 32 + F.col("k")).cast("bigint").alias("idx"),
        F.when(F.col("resname") == "ZN", F.lit("ZN")).otherwise(F.substring("atom", 1, 1)).alias("elem"),
        *[snap(_dim(i) * 100.0 + off(i)).alias(n) for i, n in enumerate("xyz")],
    )


_LISTS = "[" + ", ".join("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in a.split()) + "]" for _, a in RESIDUES) + "]"
_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in RESIDUES) + "]"
_K = "CASE WHEN k = 0 THEN 0.0 ELSE embedding[k * 3 + {j}]::DOUBLE * 20 END"
ATM = f"""atm0 AS (SELECT 0::BIGINT AS entry, label::VARCHAR AS chain, vec_id AS seq,
  ({_NAMES})[vec_id % {len(RESIDUES)} + 1] AS resname, ({_LISTS})[vec_id % {len(RESIDUES)} + 1] AS names, embedding FROM embeddings),
atm1 AS (SELECT *, unnest(range(len(names))) AS k FROM atm0),
atm AS (SELECT entry, chain, seq, '' AS icode, resname, names[k + 1] AS atom, (seq * 32 + k)::BIGINT AS idx,
  CASE WHEN resname = 'ZN' THEN 'ZN' ELSE names[k + 1][1] END AS elem,
  floor((embedding[1]::DOUBLE * 100 + {_K.format(j=1)}) * 1000 + 0.5) / 1000 + 0.0 AS x,
  floor((embedding[2]::DOUBLE * 100 + {_K.format(j=2)}) * 1000 + 0.5) / 1000 + 0.0 AS y,
  floor((embedding[3]::DOUBLE * 100 + {_K.format(j=3)}) * 1000 + 0.5) / 1000 + 0.0 AS z FROM atm1)"""


# ---------------------------------------------------------------- chains of codes
def chains(spark: SparkSession, sf: str) -> DataFrame:
    """entry (user), pos (microseconds), event_id, code, value, block (hour): events as residues of a chain."""
    e = table(spark, sf, "events")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("entry"), "event_id", t.alias("pos"), F.col("event_type").alias("code"), "value",
        F.floor(t / F.lit(3600000000)).cast("bigint").alias("block"),
    )


EVT = """evt AS (SELECT user_id AS entry, event_id, epoch_us(ts) AS pos, event_type AS code, value,
  floor(epoch_us(ts) / 3600000000)::BIGINT AS block FROM events)"""


# ---------------------------------------------------------------- alignments
def letters(spark: SparkSession, sf: str) -> DataFrame:
    """family, row, seq: the whole text of every document as letters A-Z; a family is one language and source."""
    d = table(spark, sf, "documents")
    seq = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return d.select(F.concat_ws("/", "lang", "source").alias("family"), F.col("doc_id").alias("row"), seq.alias("seq"))


SEQ = """seqs AS (SELECT lang || '/' || source AS family, doc_id AS row,
  upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS seq FROM documents),
aln AS (SELECT family, row, (i - 1)::INT AS col, seq[i] AS letter
  FROM (SELECT family, row, seq, unnest(range(1, len(seq) + 1)) AS i FROM seqs))"""


# ---------------------------------------------------------------- edges
def edges(spark: SparkSession, sf: str) -> DataFrame:
    """a (part), b (supplier), weight: how often the two meet; nodes are text so that the sides stay apart."""
    li = table(spark, sf, "lineitem")
    e = li.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("weight"))
    return e.select(
        F.lit(0).cast("bigint").alias("entry"), F.concat(F.lit("p"), F.col("l_partkey")).alias("a"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("b"), "weight",
    )


def EDG() -> str:
    return """edg AS (SELECT 0::BIGINT AS entry, 'p' || l_partkey AS a, 's' || l_suppkey AS b, count(*) AS weight
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


# ---------------------------------------------------------------- segments
def _day(c: str) -> Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1990-01-01").cast("date"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """chain (customer), domain (order), first, last (days), kind: orders as domain segments of thirty days."""
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("chain"), F.col("o_orderkey").alias("domain"), _day("o_orderdate").alias("first"),
        (_day("o_orderdate") + 30).alias("last"), F.col("o_orderpriority").alias("kind"),
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
    )


SEG = """seg AS (SELECT o_custkey AS chain, o_orderkey AS domain,
  date_diff('day', DATE '1990-01-01', o_orderdate::DATE)::INT AS first,
  (date_diff('day', DATE '1990-01-01', o_orderdate::DATE) + 30)::INT AS last, o_orderpriority AS kind,
  o_orderstatus AS status, o_totalprice AS price FROM orders)"""


def positions(spark: SparkSession, sf: str) -> DataFrame:
    """chain (customer), seq (ship day), name, value: line items as residues of their customer."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_returnflag")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("chain"), _day("l_shipdate").alias("seq"), F.col("l_orderkey").alias("ord"),
        F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("name"), F.col("l_quantity").alias("value"),
    )


POS = """pos AS (SELECT o_custkey AS chain, date_diff('day', DATE '1990-01-01', l_shipdate::DATE)::INT AS seq,
  l_orderkey AS ord, l_linenumber AS line, l_returnflag AS name, l_quantity AS value
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# ---------------------------------------------------------------- two runs
def runs_ab(spark: SparkSession, sf: str) -> DataFrame:
    """run (a: first half of the month, b: second), entry (user), slot (hour of the half), code, value."""
    e = table(spark, sf, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)) / F.lit(3600000000)).cast("bigint")
    return e.select(
        F.when(hour < 360, F.lit("a")).otherwise(F.lit("b")).alias("run"), F.col("user_id").alias("entry"),
        F.pmod(hour, F.lit(360)).cast("bigint").alias("slot"), F.col("event_type").alias("code"), "value", "event_id",
    )


RUN2 = """hrs AS (SELECT *, floor((epoch_us(ts) - 1704067200000000) / 3600000000)::BIGINT AS hour FROM events),
run2 AS (SELECT CASE WHEN hour < 360 THEN 'a' ELSE 'b' END AS run, user_id AS entry, (hour % 360)::BIGINT AS slot,
  event_type AS code, value, event_id FROM hrs)"""


# ---------------------------------------------------------------- campaigns
def campaign(spark: SparkSession, sf: str) -> DataFrame:
    """entry, stratum, source, size, q, t, judged: documents as entries with two judged criteria (null: not judged)."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = table(spark, sf, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("entry"), F.col("lang").alias("stratum"), "source", F.col("n_chars").alias("size"),
        (F.col("quality") == 1).alias("q"), (F.col("toxic") == 0).alias("t"),
    )


CAMP = """camp AS (SELECT d.doc_id AS entry, lang AS stratum, source, n_chars AS size, quality = 1 AS q, toxic = 0 AS t
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
