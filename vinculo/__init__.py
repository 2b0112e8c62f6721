"""Connected-borrower analytics on Spark: rules, portfolio queries, graph patterns, scoring."""
