"""Native functions of nucleotide strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALID_RESIDUES = "^[ACGTUNRYSWKMBDHVacgtunryswkmbdhv-]*$"


def reverse_complement(seq: Column) -> Column:
    """The other strand; case is kept, other characters are untouched."""
    return F.translate(F.reverse(seq), "ACGTacgt", "TGCAtgca")


def slice_strand(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Bases [start, end) of a read, of the other strand where ``strand`` is 1."""
    part = F.substring(seq, start + 1, end - start)
    return F.when(strand == 1, reverse_complement(part)).otherwise(part)


def kmer_number(digits: Column, position: Column, k: int) -> Column:
    """A k-mer as a number of k decimal digits, k up to 18: ``digits`` has 1 to 4 for A, C, G and T; null for others."""
    return F.substring(digits, position + 1, F.lit(k)).try_cast("bigint")


def kmer_text(number: Column) -> Column:
    """The bases of a k-mer's number."""
    return F.translate(number.cast("string"), "1234", "ACGT")


def kmer_code(kmer: Column) -> Column:
    """Two bits a base, as a long; k up to 31."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def ambiguous_runs(seq: Column) -> Column:
    """Number of runs of letters other than ACGT."""
    return F.regexp_count(seq, F.lit("[^ACGT]+"))


def ambiguous_residues(seq: Column) -> Column:
    return F.length(seq) - F.length(F.regexp_replace(seq, "[^ACGT]", ""))


def valid_residues(seq: Column) -> Column:
    return seq.rlike(VALID_RESIDUES)


def end_id(read: Column, end: int) -> Column:
    """Signed id of a read's end: begin (0) is read + 1, end (1) its negative."""
    return (read + 1) if end == 0 else -(read + 1)


def end_name(node: Column) -> Column:
    """Nine digits of the read id and B or E."""
    return F.concat(F.lpad((F.abs(node) - 1).cast("string"), 9, "0"), F.when(node > 0, ":B").otherwise(":E"))


def log2_floor(x: Column) -> Column:
    """Largest n with 2**n <= x, without rounding of doubles."""
    return (F.length(F.bin(x.cast("long"))) - 1).cast("int")


def parsed_size(text: Column) -> Column:
    """Bytes of a size such as 300, 4k, 2m or 1g."""
    unit = F.lower(F.regexp_extract(text, "([kmgKMG]?)$", 1))
    factor = F.when(unit == "k", 1 << 10).when(unit == "m", 1 << 20).when(unit == "g", 1 << 30).otherwise(1)
    return F.regexp_extract(text, "^([0-9]+)", 1).cast("long") * factor.cast("long")
