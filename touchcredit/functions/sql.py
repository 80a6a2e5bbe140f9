"""The rules as temporary SQL functions, for metrics that users write in SQL.

Catalyst puts the functions' bodies in place of their calls, so filters written with them reach the scan and nothing leaves
code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import SparkSession

from .. import constants as C
from .amounts import AMOUNT_TYPE


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _in(column: str, values: Iterable[str], empty: str = "FALSE") -> str:
    listed = ", ".join(_text(v) for v in values)
    return f"{column} IN ({listed})" if listed else empty


def _not_in(column: str, values: Iterable[str]) -> str:
    return f"({column} IS NULL OR NOT {_in(column, values)})"


def _no_match(column: str, patterns: Iterable[str]) -> str:
    joined = "|".join(f"(?:{p})" for p in patterns)
    return f"({column} IS NULL OR NOT rlike({column}, {_text(joined)}))" if joined else "TRUE"


def sql_functions(rules, codes: Mapping[str, str] = C.LINE_CODES, quote_lines: Iterable[str] = C.QUOTE_LINES) -> dict[str, str]:
    """Signature and body of every function; ``rules`` are :class:`~touchcredit.operators.CleaningRules`."""
    converted = f"try_cast(substr(t, {len(rules.converted_mark) + 2}) AS DOUBLE) * {rules.converted_rate!r}D"
    number = f"CASE WHEN contains(t, {_text(rules.converted_mark)}) THEN {converted} ELSE try_cast(substr(t, 2) AS DOUBLE) END"
    amount = f"try_cast(try_cast(rint(({number}) * 10000) AS DECIMAL(22,0)) / 10000 AS {AMOUNT_TYPE})"
    foreign = "|".join(f"(?:{p})" for p in rules.foreign_patterns)
    direct = f"{_not_in('line', rules.quote_lines)} AND {_not_in('status', rules.direct_dropped)}"
    quote = (
        f"{_in('line', rules.quote_lines)} AND {_not_in('status', rules.quote_dropped)} "
        f"AND (quotation IS NULL OR {_not_in('status', rules.issued_dropped)})"
    )
    cases = " ".join(f"WHEN {_text(line)} THEN {_text(code)}" for line, code in codes.items())
    remapped = " ".join(f"WHEN {_text(line)} THEN {_text(new)}" for line, new in rules.remapped_lines.items())
    return {
        "order_amount(t STRING) RETURNS " + AMOUNT_TYPE: f"CASE WHEN NOT rlike(t, '\\\\p{{L}}\\\\s*$') THEN {amount} END",
        "counts_as_order(line STRING, status STRING, quotation STRING, territory STRING) RETURNS BOOLEAN": (
            f"(({direct}) OR ({quote})) AND {_not_in('territory', rules.territories)}"
        ),
        "home_amount(t STRING) RETURNS BOOLEAN": f"t <> {_text(rules.zero_amount)}" + (f" AND NOT rlike(t, {_text(foreign)})" if foreign else ""),
        "outside_account(institution STRING, email STRING) RETURNS BOOLEAN": (
            f"{_no_match('institution', rules.internal_institutions)} AND {_no_match('email', rules.internal_emails)}"
        ),
        "order_line(line STRING) RETURNS STRING": f"CASE line {remapped} ELSE line END" if remapped else "line",
        "line_code(line STRING) RETURNS STRING": f"CASE line {cases} ELSE line END" if cases else "line",
        "customer_key(email STRING, code STRING) RETURNS STRING": "lower(concat(email, '*', code))",
        "confirmation(line STRING, status STRING) RETURNS STRING": (
            f"CASE WHEN {_in('line', quote_lines)} AND {_in('status', C.NON_CONFIRMED_STATUSES)} THEN 'non_confirmed' ELSE 'confirmed' END"
        ),
        "is_new(first_order TIMESTAMP_NTZ, listed BOOLEAN, cutoff TIMESTAMP_NTZ) RETURNS INT": (
            "CASE WHEN coalesce(listed, FALSE) OR coalesce(first_order < cutoff, FALSE) THEN 0 ELSE 1 END"
        ),
    }


def register_functions(
    spark: SparkSession,
    rules,
    codes: Mapping[str, str] = C.LINE_CODES,
    quote_lines: Iterable[str] = C.QUOTE_LINES,
    orders_view: str | None = None,
) -> list[str]:
    """Create the functions in this session; returns their names.

    With ``orders_view``, a view of raw orders, also the table functions ``clean_orders()`` and ``known_customers(before)``,
    whose rows are those of the operators of these names.
    """
    made = dict(sql_functions(rules, codes, list(quote_lines)))
    for signature, body in made.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    names = [signature.split("(")[0] for signature in made]
    if orders_view is None:
        return names
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION clean_orders() RETURNS TABLE (
        order_id BIGINT, created_date TIMESTAMP_NTZ, customer_email STRING, email_lob STRING, lob_type STRING, lob STRING,
        order_status STRING, promotion_code STRING, billing_amount {AMOUNT_TYPE}, confirmed STRING)
      RETURN SELECT order_id, created_date, lower(customer_email), customer_key(customer_email, line_code(order_line(lob_type))),
        order_line(lob_type), line_code(order_line(lob_type)), order_status, promotion_code, order_amount(billing_amount),
        confirmation(order_line(lob_type), order_status)
      FROM {orders_view}
      WHERE counts_as_order(lob_type, order_status, quotation_number, territory) AND home_amount(billing_amount)
        AND outside_account(institution, customer_email) AND order_amount(billing_amount) IS NOT NULL""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION known_customers(before TIMESTAMP_NTZ)
      RETURNS TABLE (customer_email STRING, first_order TIMESTAMP_NTZ)
      RETURN SELECT customer_email, min(created_date) FROM clean_orders() WHERE created_date < before GROUP BY customer_email""")
    return [*names, "clean_orders", "known_customers"]
