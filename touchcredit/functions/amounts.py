"""Amounts that arrive as text with a currency sign."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .predicates import matches_any

# A cast to double also takes words and type suffixes such as 12d, so no letter may end a number.
AMOUNT_TYPE = "decimal(18,4)"
LETTER_AT_END = r"\p{L}\s*$"


def round4(col: Column) -> Column:
    """Round a double half-even at the fourth decimal, as an exact decimal."""
    return (F.rint(col * 10000).try_cast("decimal(22,0)") / 10000).try_cast(AMOUNT_TYPE)


def is_zero(text: Column, zero: str = C.ZERO_AMOUNT) -> Column:
    return text == F.lit(zero)


def is_foreign(text: Column, patterns: Iterable[str] = C.FOREIGN_AMOUNT_PATTERNS) -> Column:
    return matches_any(text, patterns)


def parse_amount(text: Column, mark: str = C.CONVERTED_MARK, rate: float = C.CONVERTED_RATE) -> Column:
    """Text amount to a decimal with four places; null where the text is no number or too large for the type.

    The home currency has a one-character sign. The converted currency is recognised by ``mark``
    anywhere in the text, is written with one more character, and is multiplied by ``rate``.
    """
    converted = F.substr(text, F.lit(len(mark) + 2)).try_cast("double") * F.lit(rate)
    home = F.substr(text, F.lit(2)).try_cast("double")
    amount = round4(F.when(text.contains(mark), converted).otherwise(home))
    return F.when(~text.rlike(LETTER_AT_END), amount)
