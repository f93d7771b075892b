"""Link analysis on Spark: DataFrame-to-DataFrame operators for records, mentions, identities, graphs and findings."""
