"""Name folding."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters whose mark is part of the glyph, so decomposition keeps it; quotes are dropped.
TRANSLITERATE = {
    "ø": "o", "Ø": "o", "æ": "ae", "Æ": "ae", "œ": "oe", "Œ": "oe", "ł": "l", "Ł": "l", "đ": "d", "Đ": "d",
    "ð": "d", "Ð": "d", "þ": "th", "Þ": "th", "ß": "ss", "ı": "i", "'": "", "’": "", "`": "",
}


def _accent_table() -> tuple[str, str]:
    """Precomposed letters of the Latin blocks with their base letter, from the Unicode decomposition."""
    source, target = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            source.append(ch)
            target.append(base)
    return "".join(source), "".join(target)


_FROM, _TO = _accent_table()


def strip_accents(c: Column) -> Column:
    """Remove combining marks, precomposed or separate; one `translate` inside code generation."""
    return F.regexp_replace(F.translate(c, _FROM, _TO), r"\p{M}+", "")


def transliterate(c: Column) -> Column:
    single = {k: v for k, v in TRANSLITERATE.items() if len(v) == 1}
    gone = "".join(k for k, v in TRANSLITERATE.items() if not v)
    out = F.translate(c, "".join(single) + gone, "".join(single.values()))
    for k, v in TRANSLITERATE.items():
        if len(v) > 1:
            out = F.replace(out, F.lit(k), F.lit(v))
    return out


def fold_name(c: Column) -> Column:
    """Case, accents, ligatures and quotes folded away."""
    return F.trim(F.lower(strip_accents(transliterate(c))))


def same_name(a: Column, b: Column) -> Column:
    """Equality under case- and accent-insensitive collation."""
    return F.collate(a, "UNICODE_CI_AI") == F.collate(b, "UNICODE_CI_AI")
