"""Column functions on nucleotide and protein sequences."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Complements of the IUPAC codes, fixed values.
COMPLEMENT = ("ACGTRYKMBVDHSWN-.", "TGCAYRMKVBHDSWN-.")
#: Amino acids of the standard genetic code, codons in the order TCAG, a fixed value.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = dict(zip(map("".join, product("TCAG", repeat=3)), AMINO_ACIDS))


def count_of(seq: Column, letters: str) -> Column:
    """How many characters of seq are among letters."""
    return (F.length(seq) - F.length(F.translate(seq, letters, ""))).cast("long")


def gc_percent(seq: Column) -> Column:
    """GC over A, C, G, T, U; 0 without any."""
    upper = F.upper(seq)
    return F.coalesce(F.try_divide(F.lit(100.0) * count_of(upper, "GC"), count_of(upper, "ACGTU")), F.lit(0.0))


def n_percent(seq: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(100.0) * count_of(F.upper(seq), "N"), F.length(seq)), F.lit(0.0))


def reverse_complement(seq: Column) -> Column:
    """Upper-cased; RNA if it has U. T and U in one sequence raise an error."""
    upper = F.upper(seq)
    dna = F.translate(upper, *COMPLEMENT)
    rna = F.translate(upper, COMPLEMENT[0].replace("T", "U"), COMPLEMENT[1].replace("T", "U"))
    has_u = upper.contains("U")
    mixed = has_u & upper.contains("T")
    return F.reverse(F.when(mixed, F.raise_error(F.lit("sequence has both T and U"))).when(has_u, rna).otherwise(dna))


#: By the codon's digits in base 4 read as a decimal number; what is no codon has none.
_BY_DIGITS = [AMINO_ACIDS[(i // 100) * 16 + (i // 10 % 10) * 4 + i % 10] if all(int(c) < 4 for c in str(i)) else "X" for i in range(334)]


def amino_acids(dna: Column) -> Column:
    """Amino acids of the codons of dna from its start, X for what is no codon."""
    digits = F.translate(F.regexp_replace(dna, "[^TCAG]", "9"), "TCAG", "0123")
    codons = F.regexp_extract_all(digits, F.lit("(.{3})"), F.lit(1))
    table = F.array(*[F.lit(a) for a in _BY_DIGITS])
    return F.transform(codons, lambda c: F.coalesce(F.get(table, c.cast("int")), F.lit("X")))


def translate_frame(seq: Column, frame: int, stop_at_first: bool = False, trim_terminal_stop: bool = False) -> Column:
    """Protein of a frame in 1, 2, 3, -1, -2, -3; a partial codon at the end goes."""
    strand = F.upper(seq) if frame > 0 else reverse_complement(seq)
    protein = F.array_join(amino_acids(F.substring(F.translate(strand, "U", "T"), abs(frame), 2**31 - 1)), "")
    if stop_at_first:
        return F.substring_index(protein, "*", 1)
    return F.regexp_replace(protein, r"\*$", "") if trim_terminal_stop else protein


def kmers(seq: Column, k: int) -> Column:
    """All windows of k characters, in order, found in one pass."""
    return F.regexp_extract_all(seq, F.lit(f"(?=(.{{{k}}}))"), F.lit(1))


def canonical_kmer(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement."""
    return F.least(kmer, F.reverse(F.translate(kmer, "ACGT", "TGCA")))


def wrapped(seq: Column, width: int = 80) -> Column:
    """Lines of width characters."""
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")
