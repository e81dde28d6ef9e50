"""Direction of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges of strong right-to-left characters.
RTL = r"\x{0590}-\x{07BF}\x{0800}-\x{085F}\x{08A0}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{10800}-\x{10FFF}\x{1E800}-\x{1EFFF}"


def rtl_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[{RTL}]"))


def ltr_count(c: Column) -> Column:
    """Letters that run from left to right; digits and signs are neutral."""
    return F.char_length(F.regexp_replace(c, rf"[^\p{{L}}]|[{RTL}]", ""))


def bidi_class(c: Column) -> Column:
    """'R', 'L' or 'N' of a text's first character."""
    first = F.substring(c, 1, 1)
    return F.when(first.rlike(f"[{RTL}]"), "R").when(first.rlike(r"\p{L}"), "L").otherwise("N")


def is_rtl(c: Column) -> Column:
    """Whether a text runs from right to left: more of its strong characters do."""
    plain = F.octet_length(c) == F.char_length(c)
    return F.when(plain, F.lit(False)).otherwise(rtl_count(c) > ltr_count(c))


def joined(pieces: Column) -> Column:
    """Pieces from left to right as one text in reading order: turned around where they run from right to left."""
    together = F.array_join(pieces, "")
    return F.array_join(F.when(is_rtl(together), F.reverse(pieces)).otherwise(pieces), " ")
