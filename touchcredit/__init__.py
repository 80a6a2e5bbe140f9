"""touchcredit: campaign attribution on Spark DataFrames."""
