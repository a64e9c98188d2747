"""Blank nodes in files: one node in all parts of a graph that was written here, and in no other graph or file."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A label that says which graph its node is of.
SCOPED = r"g[0-9a-f]{32}\..+"


def graph_label() -> str:
    """The beginning of all blank node labels of a graph that is about to be written."""
    return f"g{uuid.uuid4().hex}"


def mark_of(path: Column) -> Column:
    """What blank nodes of a file are named by."""
    return F.concat(F.lit("f"), F.substr(F.sha2(path, 256), F.lit(1), F.lit(16)))


def blank_name(label: str, mark: str) -> str:
    """The term of a file's blank node: a scoped label as it is, any other by the file. Nodes without a label have names of another form."""
    return f"_:{label}" if re.fullmatch(SCOPED, label) else f"_:{mark}l{label}"


def named(term: Column, path: Column) -> Column:
    """``blank_name`` for a column of terms; what is no blank node stays."""
    return F.when(term.startswith("_:") & ~term.rlike(f"^_:{SCOPED}$"), F.concat(F.lit("_:"), mark_of(path), F.lit("l"), F.substr(term, F.lit(3)))).otherwise(term)


def scoped(term: Column, graph: str) -> Column:
    """The term as it is written: blank nodes get labels of the graph; labels that a format lacks, or that are another graph's, their digest."""
    label = F.substr(term, F.lit(3))
    plain = label.rlike(r"^[A-Za-z0-9_]([A-Za-z0-9_.-]*[A-Za-z0-9_-])?$") & ~label.rlike(f"^{SCOPED}$")
    return F.when(term.startswith("_:"), F.concat(F.lit(f"_:{graph}."), F.when(plain, F.concat(F.lit("l"), label)).otherwise(F.concat(F.lit("x"), F.sha2(label, 256))))).otherwise(term)
