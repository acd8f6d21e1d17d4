"""Text columns: folding, stripping, slugs, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Polish capitals and the letters they fold to.
DIACRITICS = ("ĄĆĘŁŃÓŚŹŻ", "ACELNOSZZ")

# White space, with the non-breaking spaces used between thousands.
SPACES = r"[\s\u00A0\u2007\u202F]"

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def fold(text: Column, letters: tuple[str, str] = DIACRITICS) -> Column:
    """Upper case without diacritics, for comparing spellings."""
    return F.translate(F.upper(text), *letters)


def fold_literal(text: str, letters: tuple[str, str] = DIACRITICS) -> str:
    """`fold` for dictionary keys held on the driver."""
    return text.upper().translate(str.maketrans(*letters))


def replace_first(text: Column, literal: str, new: str = "") -> Column:
    """Replace only the first occurrence of ``literal``."""
    plain = len(literal) == 1 and literal not in ".$|()[{^?*+\\"
    return F.array_join(F.split(text, literal if plain else f"\\Q{literal}\\E", 2), new)


def strip_whitespace(text: Column) -> Column:
    """Remove leading and trailing white space of any kind, also tabs and non-breaking spaces."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slug_to_name(slug: Column, noise: str = "dzialka") -> Column:
    """``dzialka-stare-kupiski`` becomes ``STARE KUPISKI``."""
    words = F.replace(F.replace(slug, F.lit(noise), F.lit("")), F.lit("-"), F.lit(" "))
    return F.upper(strip_whitespace(words))


def parse_quantity(
    text: Column, unit: str = " m2", strict: bool = False, spaces: str = "all", comma: str = ","
) -> Column:
    """Number in a text such as ``1 234,5 m2``.

    ``spaces`` tells which thousands separators go: ``all``, ``first`` or ``none``. Unreadable text
    raises an error if ``strict``, else gives null.
    """
    body = replace_first(text, unit)
    if spaces == "all":
        body = F.regexp_replace(body, SPACES, "")
    elif spaces == "first":
        body = replace_first(body, " ")
    elif spaces != "none":
        raise ValueError(f"spaces: {spaces}")
    body = replace_first(body, comma, ".")
    if strict:
        return body.cast("double")
    return F.when(body.rlike(NUMBER), body).try_cast("double")


def mentions(text: Column, pattern: str) -> Column:
    """Regex test in which a null text counts as no match."""
    return F.coalesce(text.rlike(pattern), F.lit(False))
