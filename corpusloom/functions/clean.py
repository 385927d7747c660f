"""Text cleaning, Column to Column.

Only Unicode composition leaves the JVM, as Spark has no function for it, and of texts
only those that hold a character which composition may change.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.tokens import contains_any, let

# The patterns and marks of the two cleaners, here and in the functions below.
CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
RULES = r"(?mdU)^[=\-*#~]{3,}\s*$"
BULLETS = r"(?mdU)^[•●▪▸→►✓✔-]\s+"


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Any character but those of which none is a mark, composes with another or has another composed form.
COMPOSABLE = r"[^\x{0}-\x{2ff}\x{2002}-\x{20cf}\x{2100}-\x{2125}\x{212c}-\x{2328}\x{232b}-\x{2adb}]"


@F.pandas_udf(T.StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed Unicode. Texts in ASCII, and those without a character from U+0300, are
    told by cheaper means than the pattern."""
    far = (F.octet_length(text) > F.length(text)) & text.rlike(r"[\x{300}-\x{10ffff}]")
    return F.coalesce(_composed(F.when(far & text.rlike(COMPOSABLE), text)), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def drop_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def drop_rule_lines(text: Column) -> Column:
    return F.regexp_replace(text, RULES, "")


def trim_lines(text: Column) -> Column:
    """All line ends become line feeds; white space before them goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\r\n|[\r\x85  ]", "\n"), r"(?U)[^\S\n]+(?=\n|\z)", "")


def fold_quotes(text: Column) -> Column:
    """Only the marks U+201B, U+201E and U+201F fold; common curly quotes stay."""
    return F.translate(text, "‛‟„", "'\"\"")


def fold_dashes(text: Column) -> Column:
    return F.translate(text, "–—", "--")


def fold_bullets(text: Column) -> Column:
    return F.regexp_replace(text, BULLETS, "- ")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, " {2,}", " ")


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def clean_text(text: Column, *, compose: bool = True) -> Column:
    """The document cleaner; tabs become spaces after spaces are collapsed."""
    text = nfc(text) if compose else text
    text = F.regexp_replace(text, "^﻿+", "")
    for step in (drop_controls, drop_rule_lines, trim_lines, fold_quotes, fold_dashes, fold_bullets, collapse_spaces, collapse_blank_lines):
        text = step(text)
    return strip(F.translate(text, "\t", " "))


def remove_html(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", "")


def mask_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)https?://\S+|www\.\S+", "[URL]")


def mask_emails(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\S+@\S+\.\S+", "[EMAIL]")


def normalize_whitespace(text: Column) -> Column:
    return strip(collapse_blank_lines(collapse_spaces(text)))


def remove_special(text: Column, *, keep_punctuation: bool = True) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s.,;:!?()\-'\"/%°]" if keep_punctuation else r"(?U)[^\w\s]", "")


def clean_numbers(text: Column) -> Column:
    """Thousands lose their point, decimal commas become points; one pass each."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d)\.(\d{3})(?!\d)", "$1$2"), r"(\d),(\d)", "$1.$2")


def clean_html_text(text: Column, *, compose: bool = True) -> Column:
    text = nfc(text) if compose else text
    for step in (remove_html, mask_urls, mask_emails, clean_numbers):
        text = step(text)
    return normalize_whitespace(text)


#: Characters that a pattern takes for a letter of either case, though lower-casing leaves or splits them.
FOLDED = ("ſıİ\u212a", "siik")


def _where(text: Column, guard: Callable[[Column], Column], pattern: str, to: str) -> Column:
    """Replace ``pattern`` in texts that may hold it: most hold none of a table's terms,
    and looking for one costs far less than running its pattern."""
    return let(text, lambda t: F.when(guard(t), F.regexp_replace(t, pattern, to)).otherwise(t))


def expand_abbreviations(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    """``X`` becomes ``expansion (X)``, rule after rule on what came before."""
    for short, long in table:
        text = _where(text, lambda t: F.contains(t, F.lit(short)), rf"(?U)\b{re.escape(short)}\b", f"{long} ({short})".replace("$", r"\$"))  # noqa: B023  used at once
    return text


def space_units(text: Column, units: Sequence[tuple[str, bool]]) -> Column:
    for names, whole in units:
        text = F.regexp_replace(text, rf"(?U)(\d+)({names})" + (r"\b" if whole else ""), "$1 $2")
    return text


def fix_typos(text: Column, table: Sequence[tuple[str, str]]) -> Column:
    """Any case matches; the correction is written as it stands in the table. Texts that hold
    none of the terms stay as they are, and are lower-cased once for all rules."""
    folded = lambda t: F.lower(F.translate(t, *FOLDED))

    def fixed(text: Column) -> Column:
        for wrong, right in table:
            text = _where(text, lambda t: F.contains(folded(t), F.lit(wrong.lower())), rf"(?iU)\b{re.escape(wrong)}\b", right)  # noqa: B023  used at once
        return text

    some = lambda t: let(folded(t), lambda low: contains_any(low, [wrong.lower() for wrong, _ in table]))
    return let(text, lambda t: F.when(some(t), fixed(t)).otherwise(t))


def normalize_text(text: Column, *, abbreviations=(), units=(), typos=()) -> Column:
    return fix_typos(space_units(expand_abbreviations(text, abbreviations), units), typos)
