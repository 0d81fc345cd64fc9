"""Column functions on text. All of them stay in the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in any script, control characters and the invisible format characters.
_EDGES = "".join(c for c in map(chr, range(0x110000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc", "Cf"))


def strip(c: Column) -> Column:
    """Remove white space and invisible characters at both ends. Texts with visible ASCII at both ends, nearly all, are spared the search."""
    clean = F.left(c, F.lit(1)).between("!", "~") & F.right(c, F.lit(1)).between("!", "~")
    return F.when(clean, c).otherwise(F.btrim(c, F.lit(_EDGES)))


def key(c: Column) -> Column:
    """A reference as compared: without surrounding white space and letter case; blank gives null."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def visible(c: Column) -> Column:
    """Whether anything can be seen in a text; null counts as nothing."""
    return F.coalesce(c.rlike(r"[^\s\p{Z}\p{C}]"), F.lit(False))
