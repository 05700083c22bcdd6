"""Operators on atoms (chain, residue, x, y, z) in space."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One-letter codes of residues, fixed values.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K", "MET": "M",
    "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "A": "A", "C": "C", "G": "G", "U": "U", "DA": "A", "DC": "C", "DG": "G", "DT": "T",
}


def contact_map(atoms: DataFrame, cutoff: float = 8.0, inter_chain: bool = True) -> DataFrame:
    """(a, b, distance, inter_chain) of residues a < b within the cutoff.

    One side is dealt to the 27 cells around its own, the other to its cell, so only near
    atoms are compared.
    """
    cell = lambda c: F.floor(F.col(c) / cutoff)
    base = atoms.select("chain", "residue", "x", "y", "z", cell("x").alias("cx"), cell("y").alias("cy"), cell("z").alias("cz"))
    shifts = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk")]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    left = base.select(*[F.col(c).alias(f"a_{c}") for c in ("chain", "residue", "x", "y", "z")], "cx", "cy", "cz", F.explode(shifts).alias("s"))
    left = left.select("a_chain", "a_residue", "a_x", "a_y", "a_z", *[(F.col(f"c{n}") + F.col(f"s.{m}")).alias(f"c{n}") for n, m in zip("xyz", "ijk")])
    right = base.select(*[F.col(c).alias(f"b_{c}") for c in ("chain", "residue", "x", "y", "z")], "cx", "cy", "cz")
    square = lambda c: (F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}"))
    rows = left.join(right, ["cx", "cy", "cz"]).where("a_residue < b_residue").withColumn("distance", F.sqrt(square("x") + square("y") + square("z"))).where(F.col("distance") <= cutoff)
    rows = rows.select(F.col("a_residue").alias("a"), F.col("b_residue").alias("b"), "distance", (F.col("a_chain") != F.col("b_chain")).alias("inter_chain"))
    return rows if inter_chain else rows.where("NOT inter_chain")


def summary(atoms: DataFrame) -> DataFrame:
    """Per chain: atoms and the bounds of their places."""
    return atoms.groupBy("chain").agg(F.count(F.lit(1)).alias("atoms"), *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def plddt_bands(residues: DataFrame) -> DataFrame:
    """(band, n) of (residue, b): mean B of each residue, from 90, 70, 50 or below."""
    mean = residues.groupBy("residue").agg(F.avg("b").alias("b"))
    band = F.when(F.col("b") >= 90, "very-high").when(F.col("b") >= 70, "confident").when(F.col("b") >= 50, "low").otherwise("very-low")
    return mean.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def sequences(atoms: DataFrame) -> DataFrame:
    """(chain, seq): one letter for each distinct (resseq, icode, resname) in file order, X if unknown; needs `ord` and `resname`."""
    first = atoms.groupBy("chain", "resseq", "icode", "resname").agg(F.min("ord").alias("ord"))
    letter = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in RESIDUES.items() for v in kv]), F.col("resname")), F.lit("X"))
    rows = first.groupBy("chain").agg(F.array_sort(F.collect_list(F.struct("ord", letter.alias("c")))).alias("r"))  # the residues of one chain
    return rows.select("chain", F.array_join(F.transform("r", lambda r: r["c"]), "").alias("seq"))


def _between(a: str, b: str) -> list:
    return [F.col(f"{b}.{c}") - F.col(f"{a}.{c}") for c in "xyz"]


def _dot(u: list, v: list):
    return sum((p * q for p, q in zip(u, v)), F.lit(0.0))


def distance_of(a: str, b: str):
    """Distance of two columns of places."""
    return F.sqrt(_dot(_between(a, b), _between(a, b)))


def angle_of(a: str, b: str, c: str):
    """Angle at b in degrees."""
    u, v = _between(b, a), _between(b, c)
    return F.degrees(F.acos(_dot(u, v) / F.sqrt(_dot(u, u)) / F.sqrt(_dot(v, v))))


def _cross(u: list, v: list) -> list:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def torsion_of(a: str, b: str, c: str, d: str):
    """Torsion of four columns of places around b - c, in degrees."""
    u, v, w = _between(a, b), _between(b, c), _between(c, d)
    n, m = _cross(u, v), _cross(v, w)
    return F.degrees(F.atan2(_dot(_cross(n, m), v) / F.sqrt(_dot(v, v)), _dot(n, m)))


def geometry(points: list[tuple]) -> float:
    """Distance of two points, angle of three or torsion of four, in degrees."""
    p = [np.array(x, float) for x in points]
    if len(p) == 2:
        return float(np.linalg.norm(p[0] - p[1]))
    if len(p) == 3:
        u, v = p[0] - p[1], p[2] - p[1]
        return math.degrees(math.acos(float(np.clip(u @ v / np.linalg.norm(u) / np.linalg.norm(v), -1, 1))))
    if len(p) == 4:
        a, b, c = p[1] - p[0], p[2] - p[1], p[3] - p[2]
        n, m = np.cross(a, b), np.cross(b, c)
        return math.degrees(math.atan2(float(np.cross(n, m) @ (b / np.linalg.norm(b))), float(n @ m)))
    raise ValueError("two, three or four points")


def superposed(spark: SparkSession, reference: DataFrame, mobile: DataFrame) -> DataFrame:
    """One row: pairs, rmsd before and after the best rotation, which is row_major r00..r22.

    Sums over the matched pairs are all that leaves the executors.
    """
    a, b = reference.select("chain", "residue", *[F.col(c).alias(f"p{c}") for c in "xyz"]), mobile.select("chain", "residue", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    pairs = a.join(b, ["chain", "residue"])
    sums = [F.sum(f"{s}{c}").alias(f"{s}{c}") for s in "pq" for c in "xyz"]
    cross = [F.sum(F.col(f"p{c}") * F.col(f"q{e}")).alias(f"{c}{e}") for c in "xyz" for e in "xyz"]
    squares = [F.sum(sum(F.col(f"{s}{c}") * F.col(f"{s}{c}") for c in "xyz")).alias(f"{s}{s}") for s in "pq"]
    apart = F.sum(sum((F.col(f"p{c}") - F.col(f"q{c}")) * (F.col(f"p{c}") - F.col(f"q{c}")) for c in "xyz")).alias("apart")
    r = pairs.agg(F.count(F.lit(1)).alias("n"), *sums, *cross, *squares, apart).first()
    if r.n < 3:
        raise ValueError("at least three matching atoms are needed")
    p, q = np.array([r.px, r.py, r.pz]) / r.n, np.array([r.qx, r.qy, r.qz]) / r.n
    h = np.array([[r[f"{c}{e}"] for e in "xyz"] for c in "xyz"]).T - r.n * np.outer(q, p)
    u, s, vt = np.linalg.svd(h)
    sign = np.sign(np.linalg.det(vt.T @ u.T))
    rotation = vt.T @ np.diag([1, 1, sign]) @ u.T
    spread = r.pp - r.n * p @ p + r.qq - r.n * q @ q - 2 * (s[0] + s[1] + sign * s[2])
    row = (int(r.n), math.sqrt(r.apart / r.n), math.sqrt(max(0.0, float(spread)) / r.n), *map(float, rotation.reshape(-1)))
    return spark.createDataFrame([row], "pairs long, rmsd_before double, rmsd double, " + ", ".join(f"r{i}{j} double" for i in range(3) for j in range(3)))
