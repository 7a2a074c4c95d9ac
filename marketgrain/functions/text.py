"""Column functions on text. All of them stay in the JVM (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters without width: soft hyphen, zero-width space and joiners, direction and word-joiner marks, BOM.
INVISIBLE = "[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
#: Blanks that are not the plain one.
BLANKS = "[\\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def full_width_to_plain(c: Column) -> Column:
    """Full-width ASCII (U+FF01..U+FF5E) to ordinary ASCII."""
    wide = "".join(chr(o) for o in range(0xFF01, 0xFF5F))
    plain = "".join(chr(o) for o in range(0x21, 0x7F))
    return F.translate(c, wide, plain)


def plain(c: Column) -> Column:
    """Lower-cased text of normal width with single blanks and nothing invisible; null stays null."""
    odd = F.regexp_replace(F.regexp_replace(full_width_to_plain(c), INVISIBLE, ""), BLANKS, " ")
    # most texts have nothing to replace, which one look tells
    return F.lower(F.trim(F.when(c.rlike("[^ -~\\u0400-\\u04ff]|  "), odd).otherwise(c)))


# Cyrillic and Greek letters that look like a Latin one in either case, and these Latin letters.
LOOKALIKES = "асеорхуіјѕкмтвнοανρικτ"
LATIN = "aceopxyijskmtbhoavpikt"


def fold_lookalikes(c: Column) -> Column:
    """Lower-cased text whose Cyrillic and Greek look-alike letters are replaced by Latin ones.

    The result is only a comparison form: different spellings with look-alike letters become equal.
    """
    return F.translate(F.lower(c), LOOKALIKES, LATIN)


def store_key(c: Column) -> Column:
    """Store name without regard to case and outer or repeated blanks."""
    return plain(c)
