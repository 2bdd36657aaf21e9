"""Evidence-ledger analytics on Spark."""
