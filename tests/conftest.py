import math

import pytest

from molframe.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s


ATOM = "{rec:<6}{n:>5} {atom:<4}{alt:1}{res:>3} {chain:1}{seq:>4}{icode:1}   {x:8.3f}{y:8.3f}{z:8.3f}{occ:6.2f}{b:6.2f}          {el:>2}"


def pdb_line(n, atom, res, chain, seq, xyz, rec="ATOM", alt=" ", icode=" ", b=10.0, el=None):
    name = f" {atom}" if len(atom) < 4 else atom
    return ATOM.format(rec=rec, n=n, atom=name, alt=alt, res=res, chain=chain, seq=seq, icode=icode, x=xyz[0], y=xyz[1], z=xyz[2], occ=1.0, b=b, el=el or atom[0])


def place(a, b, c, bond, angle, torsion):
    """The point at `bond` from c, `angle` at c and `torsion` about b-c."""
    sub = lambda p, q: [p[i] - q[i] for i in range(3)]
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    cross = lambda p, q: [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]]
    bc = unit(sub(c, b))
    n = unit(cross(sub(b, a), bc))
    m = cross(n, bc)
    t, f = math.radians(angle), math.radians(torsion)
    d = [-bond * math.cos(t), bond * math.sin(t) * math.cos(f), bond * math.sin(t) * math.sin(f)]
    return [c[i] + d[0] * bc[i] + d[1] * m[i] + d[2] * n[i] for i in range(3)]


def helix(n, phi=-57.0, psi=-47.0):
    """Backbone of n residues with ideal bonds and the given torsions: list of {N, CA, C, O}."""
    at = [[0.0, 0.0, 0.0], [1.458, 0.0, 0.0], [2.009, 1.420, 0.0]]
    out = []
    for _ in range(n):
        N, CA, C = at[-3:]
        nxt = place(N, CA, C, 1.329, 116.2, psi)
        o = place(N, CA, C, 1.231, 120.5, psi + 180.0)
        out.append({"N": N, "CA": CA, "C": C, "O": o})
        ca = place(CA, C, nxt, 1.458, 121.7, 180.0)
        at += [nxt, ca, place(C, nxt, ca, 1.525, 111.0, phi)]
    return out
