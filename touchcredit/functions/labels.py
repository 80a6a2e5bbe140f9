"""Labels and keys derived from one order row."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def line_code(line: Column, codes: Mapping[str, str] = C.LINE_CODES) -> Column:
    """Short code of a line of business; a line without a code keeps its long name."""
    if not codes:
        return line
    table = F.create_map(*[F.lit(part) for pair in codes.items() for part in pair])
    return F.coalesce(F.element_at(table, line), line)


def customer_key(email: Column, code: Column) -> Column:
    """``email*line`` in lower case; null if either part is null."""
    return F.lower(F.concat(email, F.lit("*"), code))


def quote_based(line: Column, quote_lines: Iterable[str] = C.QUOTE_LINES) -> Column:
    """1 for a line that starts with a quote, else 0; a null line counts as direct."""
    return F.when(line.isin(list(quote_lines)), 1).otherwise(0)


def confirmed(
    status: Column,
    quote: Column | None = None,
    open_statuses: Iterable[str] = C.NON_CONFIRMED_STATUSES,
) -> Column:
    """``non_confirmed`` while the status is still open, else ``confirmed``; a null status is confirmed.

    With ``quote`` (a 0/1 column) only quote-based orders can be unconfirmed; without it every order can.
    """
    still_open = status.isin(list(open_statuses))
    if quote is not None:
        still_open = (quote == 1) & still_open
    return F.when(still_open, "non_confirmed").otherwise("confirmed")
