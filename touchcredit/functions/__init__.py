"""Column expressions. All of them are built-in Spark functions, so they stay inside codegen."""

from .amounts import is_foreign, is_zero, parse_amount, round4
from .predicates import contains_word, matches_any, not_in, not_matching
from .labels import confirmed, customer_key, line_code, quote_based
from .sql import register_functions
from .times import at, minute_number, parse_time, unreadable

__all__ = [
    "at",
    "confirmed",
    "contains_word",
    "customer_key",
    "is_foreign",
    "is_zero",
    "line_code",
    "matches_any",
    "minute_number",
    "not_in",
    "not_matching",
    "parse_amount",
    "parse_time",
    "quote_based",
    "register_functions",
    "round4",
    "unreadable",
]
