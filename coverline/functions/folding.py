"""Texts without case and accents, in Spark functions alone."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from coverline.functions.columns import let

#: Blocks whose characters are taken apart: Latin, Greek and Cyrillic letters, punctuation and letter-like signs, ligatures, wide forms.
BLOCKS = ((0xA0, 0x250), (0x370, 0x530), (0x1E00, 0x2000), (0x2000, 0x2150), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))
#: Marks that are left out wherever they stand: combining accents, Hebrew points, Arabic vowel signs.
MARKS = r"[̀-ͯ҃-֑҇-ֽً-ٰٕ]+"


@functools.cache
def tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Characters that become one other, these others, and characters that become several."""
    one, other, several = [], [], []
    for first, stop in BLOCKS:
        for c in map(chr, range(first, stop)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain != c and len(plain) == 1:
                one.append(c)
                other.append(plain)
            elif len(plain) > 1:
                several.append((c, plain))
    return "".join(one), "".join(other), tuple(several)


def fold_text(text: Column | str) -> Column:
    """Lower case without accents; compatibility forms of the blocks above are taken apart. Texts in ASCII are only lowered."""
    text = F.col(text) if isinstance(text, str) else text
    one, other, several = tables()

    def apart(t: Column) -> Column:
        for c, plain in several:
            t = F.replace(t, F.lit(c), F.lit(plain))
        return t

    wide = "[" + "".join(f"\\x{{{ord(c):x}}}" for c, _ in several) + "]"
    folded = F.regexp_replace(F.translate(text, one, other), MARKS, "")
    folded = let(folded, lambda t: F.when(t.rlike(wide), apart(t)).otherwise(t))
    return F.lower(F.when(text.rlike(r"[^\x00-\x7F]"), folded).otherwise(text))
