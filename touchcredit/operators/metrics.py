"""Counts, revenue and distinct customers per campaign.

A report is a list of measures computed in one pass. Every row is marked with the conditions it meets, a bit for
each; rows are added up by their marks, and a customer's marks are put together before customers are counted by them.
So work on a row or a customer does not grow with the number of measures, which are taken from the few sums by marks.
There is neither an ``Expand`` nor one task per campaign.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from .reshape import spine_join


#: Marks in one number.
WORD = 62


@dataclass(frozen=True)
class Measure:
    """``kind`` is ``orders`` (count of orders with an email), ``revenue`` or ``customers`` (distinct)."""

    name: str
    kind: str
    when: Column | None = None


def _orders_and_revenue(order_name: str, revenue_name: str, when: Column | None) -> list[Measure]:
    return [Measure(order_name, "orders", when), Measure(revenue_name, "revenue", when)]


def confirmed_measures(label: str = "", line: str | None = None, count: str = "Order") -> list[Measure]:
    """Orders and revenue by confirmation, of one line or of all."""
    out: list[Measure] = []
    for state, title in (("non_confirmed", "NonConfirmed"), ("confirmed", "Confirmed")):
        when = F.col("confirmed") == state
        if line is not None:
            when = (F.col("lob_type") == line) & when
        out += _orders_and_revenue(f"{label}{title}{count}", f"{label}{title}Revenue", when)
    return out


def quote_measures(labels: Mapping[str, str] = C.QUOTE_LABELS, count: str = "Number") -> list[Measure]:
    """Quote-based lines: orders and revenue by confirmation, per line."""
    return [m for label, line in labels.items() for m in confirmed_measures(f"{label}_", line, count)]


def direct_measures(labels: Mapping[str, str] = C.DIRECT_LABELS) -> list[Measure]:
    """Direct lines: orders and revenue per line."""
    return [
        m
        for label, line in labels.items()
        for m in _orders_and_revenue(f"{label}_Order", f"{label}_Revenue", F.col("lob_type") == line)
    ]


def _new_line_conditions(labels: Mapping[str, str] | None) -> list[tuple[str, Column]]:
    new = F.col("new_to_lob") == 1
    if labels is None:
        return [("LoB", new)]
    return [(label, new & (F.col("lob") == code)) for label, code in labels.items()]


def status_measures(company: str, labels: Mapping[str, str] | None = C.NEW_LINE_LABELS) -> list[Measure]:
    """Orders and revenue of returning customers, of new ones, and of those new to a line.

    ``company`` is the company's short name in column names; ``labels=None`` does not split by line.
    """
    out = _orders_and_revenue("Return_Order", "Return_Revenue", F.col("new_to_company") == 0)
    cases = [(company, F.col("new_to_company") == 1), *_new_line_conditions(labels)]
    for label, when in cases:
        out += _orders_and_revenue(f"NewTo{label}_Order", f"NewTo{label}_Revenue", when)
    return out


def acquired_measures(company: str, labels: Mapping[str, str] | None = C.NEW_LINE_LABELS) -> list[Measure]:
    """Distinct new customers, and distinct customers new to a line."""
    cases = [(company, F.col("new_to_company") == 1), *_new_line_conditions(labels)]
    return [Measure(f"NewTo{label}", "customers", when) for label, when in cases]


def unique_measure() -> list[Measure]:
    return [Measure("# of unique customers", "customers")]


def total_measures() -> list[Measure]:
    return _orders_and_revenue("# of Order", "Revenue", None)


def revenue_split_measures() -> list[Measure]:
    """All revenue, and revenue of orders with a promotion code."""
    return [
        Measure("AllRevenue", "revenue"),
        Measure("WithPromoCode", "revenue", F.col("promotion_code").isNotNull()),
    ]


def order_cells(orders: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Reduce orders to cells: one row per combination of ``columns`` with ``orders`` and ``billing_amount``.

    Metrics of cells equal metrics of their orders. With the customer's keys, the line and the campaign (if
    known by then) among the columns, a customer has a bounded number of cells however many orders it
    placed, so labelling and flagging cells joins no skewed key and moves no whole orders.
    """
    return orders.groupBy(*columns).agg(
        F.count(F.lit(1)).alias("orders"), F.sum("billing_amount").alias("billing_amount")
    )


def _named(out: DataFrame, measures: Sequence[Measure], keys: Sequence[str]) -> DataFrame:
    named = [
        (f"CAST(m{i} AS DOUBLE)" if m.kind == "revenue" else f"coalesce(m{i}, 0)") + f" AS `{m.name}`"
        for i, m in enumerate(measures)
    ]
    return out.selectExpr(*[f"`{k}`" for k in keys], *named)


def measured(
    rows: DataFrame,
    measures: Sequence[Measure],
    groups: Sequence[Mapping[str, Column]],
    orders_col: str | None = None,
) -> DataFrame:
    """The measures per group. A row counts once in each of ``groups``, which name the same keys."""
    keys = list(groups[0])
    conditions = list({id(m.when): m.when for m in measures if m.when is not None}.values())
    place = {id(when): i for i, when in enumerate(conditions)}
    words = [conditions[i : i + WORD] for i in range(0, len(conditions), WORD)]
    marks = {
        f"__mark{w}": reduce(Column.bitwiseOR, [F.when(c, F.lit(1 << b).cast("long")).otherwise(0) for b, c in enumerate(word)])
        for w, word in enumerate(words)
    }
    n = F.lit(1) if orders_col is None else F.col(orders_col)
    own = {f"__key{i}_{j}": column for i, group in enumerate(groups) for j, column in enumerate(group.values())}
    values = {"__email": F.col("customer_email"), "__n": n.cast("long"), "__amount": F.col("billing_amount")}
    marked = rows.select(*[c.alias(name) for name, c in (own | values | marks).items()])
    nothing, email = F.lit(0).cast("long"), F.col("__email")

    def entry(i: int, customer: bool) -> Column:
        """A row's part in the sums, or the marks it gives its customer."""
        return F.struct(
            *[F.col(f"__key{i}_{j}").alias(key) for j, key in enumerate(keys)],
            F.lit(customer).alias("__customer"),
            email.isNotNull().alias("__known"),
            F.when(F.lit(customer), email).alias("__email"),
            *[(nothing if customer else F.col(name)).alias(name) for name in marks],
            *[(F.col(name) if customer else nothing).alias(f"{name}_given") for name in marks],
            (nothing if customer else F.col("__n")).alias("__n"),
            F.when(F.lit(not customer), F.col("__amount")).alias("__amount"),
        )

    kinds = (False, True) if any(m.kind == "customers" for m in measures) else (False,)
    entries = marked.select(F.inline(F.array(*[entry(i, kind) for i in range(len(groups)) for kind in kinds])))
    sums = [F.sum("__n").alias("__n"), F.sum("__amount").alias("__amount")]
    by = [*keys, "__customer", "__known"]
    given = [F.bit_or(f"{name}_given").alias(f"{name}_given") for name in marks]
    once = entries.groupBy(*by, "__email", *marks).agg(*sums, *given)
    # A part has its marks, a customer those its rows gave it: one of the two is empty.
    all_marks = [F.col(name).bitwiseOR(F.col(f"{name}_given")).alias(name) for name in marks]
    by_marks = once.select(*by, "__n", "__amount", *all_marks).groupBy(*by, *marks).agg(*sums, F.count(F.lit(1)).alias("__customers"))

    def value(m: Measure) -> Column:
        met = F.lit(True)
        if m.when is not None:
            w, b = divmod(place[id(m.when)], WORD)
            met = F.col(f"__mark{w}").bitwiseAND(F.lit(1 << b).cast("long")) != 0
        part, known = ~F.col("__customer"), F.col("__known")
        if m.kind == "orders":
            return F.sum(F.when(part & known & met, F.col("__n")).otherwise(0))
        if m.kind == "revenue":
            return F.sum(F.when(part, F.col("__amount") if m.when is None else F.when(met, F.col("__amount")).otherwise(0)))
        return F.sum(F.when(F.col("__customer") & known & met, F.col("__customers")).otherwise(0))

    out = by_marks.groupBy(*keys).agg(*[value(m).alias(f"m{i}") for i, m in enumerate(measures)])
    return _named(out, measures, keys)


def campaign_metrics(
    labelled: DataFrame,
    measures: Sequence[Measure],
    key: str | None = "recent_open",
    spine: DataFrame | None = None,
    orders_col: str | None = None,
) -> DataFrame:
    """All ``measures`` per ``key`` (or over all rows) in one pass.

    A row is an order, or a cell whose number of orders is in ``orders_col``. With a ``spine`` the result
    has exactly its rows in its order, nulls where a campaign has no order.
    """
    out = measured(labelled, measures, [{} if key is None else {key: F.col(key)}], orders_col)
    return out if spine is None else spine_join(out, spine, key)
