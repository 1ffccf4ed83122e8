"""Normal forms of keys and labels, as column expressions that stay inside code generation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks of a key.
BLANKS = " \t\r\n"


def norm_key(c: Column) -> Column:
    """Keys are equal if they differ only in letter case or outer blanks; null stays null."""
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def norm_label(c: Column) -> Column:
    """Labels (kinds, sources): as keys, and blank or hyphen stand for underscore."""
    return F.translate(norm_key(c), " -", "__")


def referred_table(key: Column) -> Column:
    """Name of the table that should hold a key."""
    return F.when(key.startswith("corpus:") | key.startswith("ext:"), F.lit("reference_nodes")).otherwise(F.lit("graph_nodes"))
