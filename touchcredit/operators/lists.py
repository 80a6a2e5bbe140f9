"""List of new customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C


def new_customer_list(labelled: DataFrame, source: Column, company: str) -> DataFrame:
    """Distinct customers new to the company or new to a line, from flagged orders.

    ``source`` is the campaign to name: the label, the roll-up name or a literal. One pass: a customer new
    to the company has a null ``new_to_lob``, so each row gives at most one entry. For a customer new to a
    line the first line ordered is not stated.
    """
    kind, email, name, institution, campaign, line = C.CUSTOMER_LIST_COLUMNS
    to_company, to_line = F.col("new_to_company") == 1, F.col("new_to_lob") == 1
    return (
        labelled.where(to_company | to_line)
        .select(
            F.when(to_company, f"New to {company}")
            .otherwise(F.concat(F.lit("New to "), "lob"))
            .alias(kind),
            F.col("customer_email").alias(email),
            F.col("user_name").alias(name),
            F.col("institution").alias(institution),
            source.alias(campaign),
            F.when(to_company, F.col("lob")).otherwise(C.NO_LINE).alias(line),
        )
        .distinct()
    )
