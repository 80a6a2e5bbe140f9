"""Cleaning of the raw order export.

All rules are row-local, so the whole chain is one scan, one filter and one projection: no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import is_foreign, is_zero, not_in, not_matching, parse_amount


@dataclass(frozen=True)
class CleaningRules:
    """What counts as a real order. Defaults are the fixed values; internal accounts depend on the company."""

    quote_lines: tuple[str, ...] = C.QUOTE_LINES_RAW
    direct_dropped: tuple[str, ...] = C.DIRECT_DROPPED_STATUSES
    quote_dropped: tuple[str, ...] = C.QUOTE_DROPPED_STATUSES
    issued_dropped: tuple[str, ...] = C.ISSUED_QUOTE_DROPPED_STATUSES
    territories: tuple[str, ...] = C.EXCLUDED_TERRITORIES
    zero_amount: str = C.ZERO_AMOUNT
    foreign_patterns: tuple[str, ...] = C.FOREIGN_AMOUNT_PATTERNS
    converted_mark: str = C.CONVERTED_MARK
    converted_rate: float = C.CONVERTED_RATE
    internal_institutions: tuple[str, ...] = ()
    internal_emails: tuple[str, ...] = ()
    remapped_lines: Mapping[str, str] = field(default_factory=lambda: dict(C.REMAPPED_LINES))

    @classmethod
    def for_company(cls, name: str, **changes) -> CleaningRules:
        """Rules that drop the company's own accounts.

        Institutions match the name in capitals or in small letters, emails match ``name.test`` and
        ``name.com``; all four are regular expressions and case-sensitive.
        """
        low = name.lower()
        return cls(
            internal_institutions=(name.upper(), low),
            internal_emails=(f"{low}.test", f"{low}.com"),
            **changes,
        )


def status_rule(rules: CleaningRules) -> Column:
    """Direct and quote-based orders in one disjunction, in place of two filters and a union."""
    line, status = F.col("lob_type"), F.col("order_status")
    lines = list(rules.quote_lines)
    direct = not_in(line, lines) & not_in(status, rules.direct_dropped)
    issued = F.col("quotation_number").isNotNull()
    quote = (
        line.isin(lines)
        & not_in(status, rules.quote_dropped)
        & (~issued | not_in(status, rules.issued_dropped))
    )
    return direct | quote


def territory_rule(rules: CleaningRules) -> Column:
    return not_in(F.col("territory"), rules.territories)


def internal_rule(rules: CleaningRules) -> Column:
    return not_matching(F.col("institution"), rules.internal_institutions) & not_matching(
        F.col("customer_email"), rules.internal_emails
    )


def clean_amounts(df: DataFrame, rules: CleaningRules) -> tuple[DataFrame, DataFrame]:
    """Split into rows with a usable home-currency amount and rejects.

    Zero and foreign amounts are dropped. A reject is a null or unreadable amount; it keeps its text, so
    that no order disappears silently.
    """
    text = F.col("billing_amount")
    amount = parse_amount(text, rules.converted_mark, rules.converted_rate)
    usable = ~is_zero(text, rules.zero_amount)
    if rules.foreign_patterns:
        usable = usable & ~is_foreign(text, rules.foreign_patterns)
    # Behind a generator the text and the amount are worked out once for an order. Filters on them would repeat what makes
    # them in every condition, in a method that the JVM leaves uncompiled.
    judged = df.select("*", F.inline(F.array(F.struct(F.when(usable, amount).alias("__amount")))))
    clean = judged.where("__amount IS NOT NULL").withColumn("billing_amount", F.col("__amount")).drop("__amount")
    rejects = df.where(text.isNull() | (usable & amount.isNull()))
    return clean, rejects


def remap_lines(df: DataFrame, remapped: Mapping[str, str]) -> DataFrame:
    return df.replace(dict(remapped), subset=["lob_type"]) if remapped else df


#: What a checked scan adds (:func:`~touchcredit.sources.scan_orders`).
BAD_ROW, BAD_TIME = "bad_row", "bad_time"
#: Fates of an order: the first rule that takes it away, one of three reasons to reject it, or kept.
DROPS = ("status", "territory", "zero amount", "foreign amount", "internal account")
REASONS = ("row shape", "unreadable amount", "unreadable time")
KEPT = "kept"
#: Fates whose amounts are not added up: they are of another currency, or in a row whose fields cannot be told apart.
UNCOUNTED = (DROPS[3], REASONS[0])


def order_fate(columns: list[str], rules: CleaningRules) -> Column:
    """The fate of a raw order with these columns, in one expression.

    A row of the wrong shape is judged by nothing else. Reasons to reject come after the rules, so that rejects are
    orders that would have counted.
    """
    text = F.col("billing_amount")
    fate = F.when(F.col(BAD_ROW).isNotNull(), REASONS[0]) if BAD_ROW in columns else F.when(F.lit(False), REASONS[0])
    foreign = is_foreign(text, rules.foreign_patterns) if rules.foreign_patterns else F.lit(False)
    dropped = (~status_rule(rules), ~territory_rule(rules), is_zero(text, rules.zero_amount), foreign, ~internal_rule(rules))
    for name, when in zip(DROPS, dropped, strict=True):
        fate = fate.when(F.coalesce(when, F.lit(False)), name)
    fate = fate.when(parse_amount(text, rules.converted_mark, rules.converted_rate).isNull(), REASONS[1])
    if BAD_TIME in columns:
        fate = fate.when(F.col(BAD_TIME).isNotNull(), REASONS[2])
    return fate.otherwise(KEPT)


def clean_stages(raw: DataFrame, rules: CleaningRules) -> dict[str, DataFrame]:
    """``cleaned`` (before the category remap), ``ready`` (after it) and ``rejects`` with a ``reason`` for each.

    Rows of a checked scan that have the wrong shape or a time that cannot be read are rejects as well.
    """
    added = [c for c in (BAD_ROW, BAD_TIME) if c in raw.columns]
    sound = raw
    for c in added:
        sound = sound.where(F.col(c).isNull())
    kept = sound.where(status_rule(rules)).where(territory_rule(rules))
    cleaned = clean_amounts(kept, rules)[0].where(internal_rule(rules)).drop(*added)
    rejects = raw.withColumn("reason", order_fate(raw.columns, rules)).where(F.col("reason").isin(*REASONS))
    return {"cleaned": cleaned, "ready": remap_lines(cleaned, rules.remapped_lines), "rejects": rejects}


def fate_totals(raw: DataFrame, rules: CleaningRules) -> DataFrame:
    """``fate, orders, revenue`` of all raw orders; amounts that cannot be read, foreign ones and those of rows of the wrong
    shape add nothing."""
    amount = parse_amount(F.col("billing_amount"), rules.converted_mark, rules.converted_rate)
    judged = raw.select(order_fate(raw.columns, rules).alias("fate"), amount.alias("amount"))
    home = F.when(~F.col("fate").isin(*UNCOUNTED), F.col("amount"))
    return judged.groupBy("fate").agg(F.count(F.lit(1)).alias("orders"), F.coalesce(F.sum(home), F.lit(0)).alias("revenue"))


def observed(raw: DataFrame, rules: CleaningRules) -> tuple[DataFrame, Observation]:
    """The raw orders with their fates counted by whatever reads them next, in its own scan.

    The read must be one stage, as writing the cleaned orders is: a stage that is run again after a lost executor, with
    a shuffle behind it, would count its rows again. Filters cannot pass below what is counted, so an audited run reads
    every order.
    """
    watch = Observation()
    amount = parse_amount(F.col("billing_amount"), rules.converted_mark, rules.converted_rate)
    judged = raw.withColumns({"__fate": order_fate(raw.columns, rules), "__amount": amount})
    counts = []
    for i, name in enumerate((*DROPS, *REASONS, KEPT)):
        own = F.col("__fate") == name
        counts += [F.count_if(own).alias(f"orders{i}"), F.sum(F.when(own, F.col("__amount"))).alias(f"revenue{i}")]
    return judged.observe(watch, *counts).drop("__fate", "__amount"), watch


def observed_totals(watch: Observation) -> list[tuple]:
    """(fate, orders, revenue) of all fates that occurred, once the orders were read."""
    found = watch.get
    rows = [(name, found[f"orders{i}"], found[f"revenue{i}"]) for i, name in enumerate((*DROPS, *REASONS, KEPT))]
    return [(name, n, None if name in UNCOUNTED else amount) for name, n, amount in rows if n]


def clean_orders(raw: DataFrame, rules: CleaningRules) -> tuple[DataFrame, DataFrame]:
    """Orders ready for attribution, and rejects."""
    stages = clean_stages(raw, rules)
    return stages["ready"], stages["rejects"]
