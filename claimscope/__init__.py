"""Claims decision analytics on Spark: cleaning, features, evaluation, drift, ledger, decisions."""
