"""Scalar column helpers (all JVM-side expressions, no Python UDFs)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Strip leading/trailing white space like Python's ``str.strip()`` (ASCII space class)."""
    return F.regexp_replace(col_(c), r"^\s+|\s+$", "")


def lines(c) -> Column:
    """Split text on newline, keeping empty and trailing pieces (Python ``split('\\n')``)."""
    return F.split(col_(c), NL, -1)


def nullif_blank(c) -> Column:
    c = col_(c)
    return F.when(F.length(F.trim(c)) > 0, c)


def bool_norm(c) -> Column:
    """1/1.0/true/yes -> 1, 0/0.0/false/no -> 0, anything else -> NULL."""
    s = F.lower(col_(c).cast("string"))
    return (
        F.when(s.isin("1", "1.0", "true", "yes"), F.lit(1))
        .when(s.isin("0", "0.0", "false", "no"), F.lit(0))
        .otherwise(F.lit(None).cast("int"))
    )


def to_float_safe(c) -> Column:
    """float or NULL (ANSI on: ``try_cast``)."""
    return col_(c).cast("string").try_cast("double")


def collapse_ws(c) -> Column:
    """Collapse runs of white space to one space and trim."""
    return F.trim(F.regexp_replace(col_(c), r"\s+", " "))


def template_fill(template, mapping: dict[str, Column]) -> Column:
    """Fill ``{name}`` slots; ``{{``/``}}`` stand for literal braces.

    The template is cut at its slots once and every slot is replaced in that one
    pass, so slot names or braces inside a value are ordinary text.
    """
    slots = [F.lit("{" + name + "}") for name in mapping]
    alts = "|".join(re.escape("{" + name + "}") for name in mapping)
    marked = F.replace(F.replace(col_(template), F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    pieces = F.split(marked, f"(?={alts})|(?<={alts})", -1) if alts else F.array(marked)

    def filled(piece: Column) -> Column:
        out = F.replace(F.replace(piece, F.lit("\u0001"), F.lit("{")), F.lit("\u0002"), F.lit("}"))
        for slot, value in zip(slots, mapping.values()):
            out = F.when(piece == slot, F.coalesce(value.cast("string"), F.lit(""))).otherwise(out)
        return out

    return F.array_join(F.transform(pieces, filled), "")


def stable_id(*cols, sep: str = ":") -> Column:
    """Deterministic row id (replaces random UUIDs so reruns are stable)."""
    return F.sha2(F.concat_ws(sep, *[col_(c).cast("string") for c in cols]), 256)


def rnd(c, digits: int = 6) -> Column:
    return F.round(col_(c).cast("double"), digits)
