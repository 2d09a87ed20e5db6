"""Stems whose pairs are vectors: local axes, straight pieces, bends. The SQL takes eigenvectors by the closed form."""

from __future__ import annotations

from pyspark.sql import functions as F

from molframe import bindings as B
from molframe.functions.geom import snap
from molframe.operators import stem_axis as S
from molframe.registry.base import query, with_


def pairs_and_backbone(spark, sf):
    """Every vector as a base pair: sixty-four to a stem, every ninth step skips a nucleotide of the first arm."""
    e = B.table(spark, sf, "embeddings")
    at = lambda first, scale: [snap(F.col("embedding")[first + i].cast("double") * scale) for i in range(3)]
    point = lambda p: F.struct(*[c.alias(n) for c, n in zip(p, "xyz")])
    i, j = F.col("vec_id") + F.floor(F.col("vec_id") / 9), F.lit(10_000_000) - F.col("vec_id")
    a = at(0, 100.0)
    pairs = e.select(F.lit(0).alias("entry"), F.floor(F.col("vec_id") / 64).alias("stem"), i.alias("i"), j.alias("j"), point(a).alias("a"), point([x + d for x, d in zip(a, at(3, 10.0))]).alias("b"))
    side = lambda pos, first: e.select(F.lit(0).alias("entry"), pos.alias("pos"), point(at(first, 100.0)).alias("p"))
    return pairs, side(i, 6).unionByName(side(j, 9))


def _at(d: int, scale: int) -> str:
    return f"(floor(v[{d + 1}]::DOUBLE * {scale} * 1000 + 0.5) / 1000 + 0.0)"


def _eigen(name: str, source: str, shift: str) -> list[str]:
    """CTEs that add the unit eigenvector (ex, ey, ez) of the matrix xx xy xz yy yz zz in `source`."""
    return [
        f"{name}1 AS (SELECT *, (xx + yy + zz) / 3.0 AS q FROM {source})",
        f"{name}2 AS (SELECT *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2.0 * (xy::DOUBLE ** 2 + xz::DOUBLE ** 2 + yz::DOUBLE ** 2)) / 6) AS p FROM {name}1)",
        f"""{name}3 AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, ((xx - q) / p * ((yy - q) / p * ((zz - q) / p) - yz / p * (yz / p)) - xy / p * (xy / p * ((zz - q) / p) - yz / p * (xz / p))
            + xz / p * (xy / p * (yz / p) - (yy - q) / p * (xz / p))) / 2))) / 3 + {shift}) AS l FROM {name}2)""",
        f"""{name}4 AS (SELECT *, [xy * yz - xz * (yy - l), xz * xy - (xx - l) * yz, (xx - l) * (yy - l) - xy * xy] AS c0,
            [xy * (zz - l) - xz * yz, xz * xz - (xx - l) * (zz - l), (xx - l) * yz - xy * xz] AS c1, [(yy - l) * (zz - l) - yz * yz, yz * xz - xy * (zz - l), xy * yz - (yy - l) * xz] AS c2 FROM {name}3)""",
        f"""{name}5 AS (SELECT *, CASE WHEN list_dot_product(c0, c0) >= list_dot_product(c1, c1) AND list_dot_product(c0, c0) >= list_dot_product(c2, c2) THEN c0
            WHEN list_dot_product(c1, c1) >= list_dot_product(c2, c2) THEN c1 ELSE c2 END AS c FROM {name}4)""",
        f"{name} AS (SELECT *, c[1] / sqrt(list_dot_product(c, c)) AS ex, c[2] / sqrt(list_dot_product(c, c)) AS ey, c[3] / sqrt(list_dot_product(c, c)) AS ez FROM {name}5)",
    ]


_SUMS = ", ".join(f"sum({{d}}{a} * {{d}}{b}) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))
_LEAST, _MOST = "2 * pi() / 3", "0"
PIECES = with_(
    f"""bp AS (SELECT floor(vec_id / 64)::BIGINT AS stem, vec_id + floor(vec_id / 9)::BIGINT AS i, 10000000 - vec_id AS j,
        {_at(0, 100)} AS ax, {_at(1, 100)} AS ay, {_at(2, 100)} AS az, ax + {_at(3, 10)} AS bx, ay + {_at(4, 10)} AS by_, az + {_at(5, 10)} AS bz FROM (SELECT vec_id, embedding AS v FROM embeddings))""",
    f"""bb AS (SELECT vec_id + floor(vec_id / 9)::BIGINT AS pos, {_at(6, 100)} AS px, {_at(7, 100)} AS py, {_at(8, 100)} AS pz FROM (SELECT vec_id, embedding AS v FROM embeddings)
        UNION ALL SELECT 10000000 - vec_id, {_at(9, 100)}, {_at(10, 100)}, {_at(11, 100)} FROM (SELECT vec_id, embedding AS v FROM embeddings))""",
    """pl AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY stem) AS n, coalesce(i = lag(i) OVER w + 1 AND j = lag(j) OVER w - 1, false) AS plain,
        round((bx - ax) * 1000)::BIGINT AS dx, round((by_ - ay) * 1000)::BIGINT AS dy, round((bz - az) * 1000)::BIGINT AS dz,
        (ax + bx) * 0.5 AS mx, (ay + by_) * 0.5 AS my, (az + bz) * 0.5 AS mz FROM bp WINDOW w AS (PARTITION BY stem ORDER BY i))""",
    "wd AS (SELECT *, least(n, 11, greatest(5, n // 2)) AS width, least(greatest(0, k - width // 2), n - width) AS lo FROM pl)",
    f"""wm AS (SELECT p.stem, p.k, p.n, p.plain, {_SUMS.format(d="q.d")}, arg_max(q.mx, q.k) - arg_min(q.mx, q.k) AS rx, arg_max(q.my, q.k) - arg_min(q.my, q.k) AS ry, arg_max(q.mz, q.k) - arg_min(q.mz, q.k) AS rz
        FROM wd p JOIN pl q ON q.stem = p.stem AND q.k BETWEEN p.lo AND p.lo + p.width - 1 GROUP BY p.stem, p.k, p.n, p.plain)""",
    *_eigen("we", "wm", _LEAST),
    "ax AS (SELECT stem, k, n, plain, CASE WHEN ex * rx + ey * ry + ez * rz < 0 THEN -1 ELSE 1 END AS s, ex * s AS x, ey * s AS y, ez * s AS z FROM we)",
    """st(stem, k, start, x, y, z) AS (SELECT stem, 0::BIGINT, 0::BIGINT, x, y, z FROM ax WHERE k = 0 AND n >= 10
        UNION ALL SELECT a.stem, a.k, CASE WHEN c THEN a.k ELSE start END, CASE WHEN c THEN a.x ELSE px END, CASE WHEN c THEN a.y ELSE py END, CASE WHEN c THEN a.z ELSE pz END
        FROM (SELECT a.*, st.start, st.x AS px, st.y AS py, st.z AS pz, a.plain AND a.k - st.start >= 5
            AND floor(degrees(acos(greatest(-1, least(1, a.x * st.x + a.y * st.y + a.z * st.z)))) * 1000 + 0.5) / 1000 > 25 AS c FROM st JOIN ax a ON a.stem = st.stem AND a.k = st.k + 1) a)""",
    """cu AS (SELECT DISTINCT stem, start AS lo FROM st UNION SELECT DISTINCT stem, 0 FROM pl)""",
    """ct AS (SELECT cu.stem, lo, n FROM cu JOIN (SELECT DISTINCT stem, n FROM pl) USING (stem)
        WHERE NOT (lo > 0 AND n - lo < 5 AND lo = (SELECT max(c.lo) FROM cu c WHERE c.stem = cu.stem)))""",
    "pc AS (SELECT stem, lo, coalesce(lead(lo) OVER w, n) - 1 AS hi, row_number() OVER w - 1 AS piece FROM ct WINDOW w AS (PARTITION BY stem ORDER BY lo))",
    f"""pg AS (SELECT pc.stem, piece, lo, hi, count(*) AS pairs, {_SUMS.format(d="d")}, arg_max(mx, k) - arg_min(mx, k) AS rx, arg_max(my, k) - arg_min(my, k) AS ry, arg_max(mz, k) - arg_min(mz, k) AS rz,
        min(i) AS i0, max(i) AS i1, min(j) AS j1, max(j) AS j0, sum(round(ax * 1000)::BIGINT + round(bx * 1000)::BIGINT) AS cx, sum(round(ay * 1000)::BIGINT + round(by_ * 1000)::BIGINT) AS cy, sum(round(az * 1000)::BIGINT + round(bz * 1000)::BIGINT) AS cz
        FROM pc JOIN pl ON pl.stem = pc.stem AND k BETWEEN lo AND hi GROUP BY pc.stem, piece, lo, hi)""",
    """ps AS (SELECT stem, piece, (px - avg(px) OVER w) AS dx, (py - avg(py) OVER w) AS dy, (pz - avg(pz) OVER w) AS dz FROM pg JOIN bb ON (pos BETWEEN i0 AND i1) OR (pos BETWEEN j1 AND j0)
        WHERE pairs >= 11 WINDOW w AS (PARTITION BY stem, piece))""",
    f"pb AS (SELECT stem, piece, {_SUMS.format(d='d')} FROM ps GROUP BY stem, piece)",
    *_eigen("el", "(SELECT * FROM pb)", _MOST), *_eigen("es", "(SELECT * FROM pg)", _LEAST),
    """pa AS (SELECT g.*, coalesce(el.ex, g.ex) AS fx, coalesce(el.ey, g.ey) AS fy, coalesce(el.ez, g.ez) AS fz, CASE WHEN fx * rx + fy * ry + fz * rz < 0 THEN -1 ELSE 1 END AS s,
        fx * s AS x, fy * s AS y, fz * s AS z FROM es g LEFT JOIN el USING (stem, piece))""",
)
_GRID = lambda c: f"floor({c} * 10000 + 0.5) / 10000 + 0.0"


@query("stem_pieces", "E17", PIECES + f"""SELECT stem, piece::INT AS piece, lo, hi, pairs, i0, i1, j1, j0, {_GRID("cx / (pairs * 2) / 1000.0")} AS cx, {_GRID("x")} AS x, {_GRID("y")} AS y, {_GRID("z")} AS z FROM pa""")
def stem_pieces(spark, sf):
    pairs, backbone = pairs_and_backbone(spark, sf)
    p = S.stem_pieces(pairs, backbone, ["entry"])
    return p.select("stem", "piece", "lo", "hi", "pairs", "i0", "i1", "j1", "j0", snap(F.col("centre.x"), 10000.0).alias("cx"), *[snap(F.col(f"axis.{c}"), 10000.0).alias(c) for c in "xyz"])


@query("stem_bends", "E17", PIECES + """SELECT stem, count(*) AS pieces, sum(pairs)::BIGINT AS pairs, count(*) = 1 AS straight, CASE WHEN count(*) = 1 THEN 0.0 ELSE
    floor(floor(degrees(acos(greatest(-1, least(1, arg_min(x, piece) * arg_max(x, piece) + arg_min(y, piece) * arg_max(y, piece) + arg_min(z, piece) * arg_max(z, piece))))) * 1000 + 0.5) / 1000 * 100 + 0.5) / 100 END AS bend FROM pa GROUP BY stem""")
def stem_bends(spark, sf):
    pairs, backbone = pairs_and_backbone(spark, sf)
    b = S.stem_bends(S.stem_pieces(pairs, backbone, ["entry"]), ["entry"])
    return b.select("stem", "pieces", "pairs", "straight", snap(F.col("bend"), 100.0).alias("bend"))
