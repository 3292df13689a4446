"""Code-evolution analytics on Spark: snapshots, matching, lineage, clones, rates and data quality."""
