"""Document analytics on Spark: DataFrame operators for long-form documents."""
