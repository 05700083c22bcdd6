"""Properties of protein sequences, by column expressions over the counts of the 20 residues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Average residue masses, fixed values.
MASS = {
    "A": 71.0788, "C": 103.1388, "D": 115.0886, "E": 129.1155, "F": 147.1766, "G": 57.0519, "H": 137.1411, "I": 113.1594, "K": 128.1741, "L": 113.1594,
    "M": 131.1926, "N": 114.1038, "P": 97.1167, "Q": 128.1307, "R": 156.1875, "S": 87.0782, "T": 101.1051, "V": 99.1326, "W": 186.2132, "Y": 163.1760,
}
#: Hydropathy of residues, fixed values.
HYDROPATHY = {
    "A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8,
    "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3,
}
#: Dissociation constants: of the ends, and of basic and acidic residues, fixed values.
N_TERMINUS, C_TERMINUS = 9.69, 2.34
BASIC = {"K": 10.5, "R": 12.4, "H": 6.0}
ACIDIC = {"D": 3.86, "E": 4.25, "C": 8.33, "Y": 10.07}
WATER = 18.01528


def _count(letter: str) -> Column:
    return F.col(f"n_{letter}")


def charge(ph: Column) -> Column:
    """Net charge at a pH from the residue counts."""
    plus = lambda pka: 1 / (1 + F.pow(F.lit(10.0), ph - pka))
    minus = lambda pka: 1 / (1 + F.pow(F.lit(10.0), pka - ph))
    out = plus(N_TERMINUS) - minus(C_TERMINUS)
    for a, pka in BASIC.items():
        out = out + _count(a) * plus(pka)
    for a, pka in ACIDIC.items():
        out = out - _count(a) * minus(pka)
    return out


def isoelectric_point(steps: int = 80) -> Column:
    """By bisection between 0 and 14."""

    def step(s: Column, _: Column) -> Column:
        mid = (s["lo"] + s["hi"]) * 0.5
        high = charge(mid) > 0
        return F.struct(F.when(high, mid).otherwise(s["lo"]).alias("lo"), F.when(high, s["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0.0).alias("lo"), F.lit(14.0).alias("hi")), step, lambda s: (s["lo"] + s["hi"]) * 0.5)


def properties(proteins: DataFrame) -> DataFrame:
    """Length, weight, GRAVY, aromaticity %, extinction, charge at 7 and pI; all derived values are null with B, J, O, U, X or Z."""
    seq = F.upper(F.regexp_replace("seq", r"\*$", ""))
    rows = proteins.select("id", seq.alias("seq"))
    rows = rows.select("id", "seq", *[(F.length("seq") - F.length(F.replace("seq", F.lit(a), F.lit("")))).alias(f"n_{a}") for a in MASS])
    clear = ~F.col("seq").rlike("[BJOUXZ]") & (F.length("seq") > 0)
    total = lambda table: sum((_count(a) * F.lit(v) for a, v in table.items()), F.lit(0.0))
    known = lambda c, name: F.when(clear, c).alias(name)
    reduced = _count("W") * 5500 + _count("Y") * 1490
    return rows.select(
        "id", F.length("seq").cast("long").alias("length"), known(total(MASS) + WATER, "weight"), known(total(HYDROPATHY) / F.length("seq"), "gravy"),
        known(F.lit(100.0) * (_count("F") + _count("W") + _count("Y")) / F.length("seq"), "aromaticity"), known(reduced.cast("long"), "extinction_reduced"),
        known((reduced + 125 * F.floor(_count("C") / 2)).cast("long"), "extinction_oxidized"), known(charge(F.lit(7.0)), "charge_7"), known(isoelectric_point(), "pi"),
    )
