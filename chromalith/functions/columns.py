"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounds halves to the even neighbour, as Python's round does."""
    return F.bround(x, digits)


def with_chr(c: Column) -> Column:
    """chrN for N; names that have the prefix stay."""
    return F.when(c.startswith("chr"), c).otherwise(F.concat(F.lit("chr"), c))


def cell_name(c: Column) -> Column:
    """Dots and blanks of a cell's name become underscores."""
    return F.translate(c, ". ", "__")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Each norm is at least eps."""
    norm = lambda x: F.greatest(F.sqrt(dot(x, x)), F.lit(eps))
    return dot(a, b) / (norm(a) * norm(b))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def argmax(values: Column) -> Column:
    """Index from 0 of the first largest element."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def edge_key(i: Column, j: Column, n: Column) -> Column:
    return i.cast("long") * n.cast("long") + j.cast("long")


def edge_of_key(key: Column, n: Column) -> tuple[Column, Column]:
    return F.floor(key / n).cast("int"), F.pmod(key, n.cast("long")).cast("int")


def chrom_presets(name: str, prefix: bool = True) -> list[str]:
    """Autosomes of an assembly, with or without the chr prefix."""
    last = {"hg19": 22, "hg38": 22, "mm9": 19, "mm10": 19}[name]
    return [f"{'chr' * prefix}{k}" for k in range(1, last + 1)]


def parse_chroms(text: str, prefix: bool = True) -> list[str]:
    """A preset's name, or chromosomes parted by commas or blanks; prefix: chr is put before names without it."""
    if text in ("hg19", "hg38", "mm9", "mm10"):
        return chrom_presets(text, prefix)
    names = [n for n in text.replace(",", " ").split() if n]
    if not names:
        raise ValueError("no chromosome is named")
    return list(dict.fromkeys(n if not prefix or n.startswith("chr") else f"chr{n}" for n in names))
