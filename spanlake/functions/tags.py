"""Tags: ``O`` or prefix-type, such as ``B-loc.adm.town``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from spanlake.functions.inventory import COARSE_TYPES


def tag_prefix(tag: Column) -> Column:
    """Part before the first hyphen (the whole tag without one)."""
    return F.substring_index(tag, "-", 1)


def tag_type(tag: Column) -> Column:
    """Part after the first hyphen; ``0`` counts as no type."""
    rest = F.when(F.instr(tag, "-") > 0, F.substr(tag, F.instr(tag, "-") + 1)).otherwise("")
    return F.when(rest == "0", "").otherwise(rest)


def normalise_raw(tag: Column, outside: str = "O") -> Column:
    """Tags without prefix: every token not outside is its own chunk."""
    return F.when(tag.isin(outside, "O"), "O").otherwise(F.concat(F.lit("B-"), tag))


def mention_type(tag: Column) -> Column:
    """Label of a B tag, as mention extraction reads it."""
    return F.substr(tag, F.lit(3))


def coarse_type(label: Column) -> Column:
    return F.substring_index(label, ".", 1)


def is_valid_type(coarse: Column) -> Column:
    return coarse.isin(*COARSE_TYPES)


# Prefixes as numbers: the chunk rules run on every token.
OUTSIDE, DOT, BEGIN, INSIDE, END, BRACKET, OTHER = range(7)


def prefix_code(tag: Column) -> Column:
    prefix = tag_prefix(tag)
    return (
        F.when(prefix == "O", OUTSIDE)
        .when(prefix == "I", INSIDE)
        .when(prefix == "B", BEGIN)
        .when(prefix == "E", END)
        .when(prefix == ".", DOT)
        .when(prefix.isin("[", "]"), BRACKET)
        .otherwise(OTHER)
    )


def parsed(names: Iterable[str]) -> dict[str, Column]:
    """``x_p`` (prefix code) and ``x_t`` (type) for each tag column ``x``."""
    out = {}
    for name in names:
        out[f"{name}_p"] = prefix_code(F.col(name))
        out[f"{name}_t"] = tag_type(F.col(name))
    return out


def chunk_end(prev: str, cur: str) -> Column:
    """Does the chunk holding tag ``prev`` end between the two (parsed) tags?"""
    p, c = F.col(f"{prev}_p"), F.col(f"{cur}_p")
    return (
        (p.isin(BEGIN, INSIDE) & c.isin(BEGIN, OUTSIDE))
        | ((p == END) & c.isin(END, INSIDE, OUTSIDE))
        | ((p > DOT) & (F.col(f"{prev}_t") != F.col(f"{cur}_t")))
        | (p == BRACKET)
    )


def chunk_start(prev: str, cur: str) -> Column:
    """Does a chunk start at tag ``cur``, given the tag before it?"""
    p, c = F.col(f"{prev}_p"), F.col(f"{cur}_p")
    return (
        ((c == BEGIN) & p.isin(OUTSIDE, BEGIN, INSIDE))
        | (c.isin(INSIDE, END) & p.isin(OUTSIDE, END))
        | ((c > DOT) & (F.col(f"{prev}_t") != F.col(f"{cur}_t")))
        | (c == BRACKET)
    )
