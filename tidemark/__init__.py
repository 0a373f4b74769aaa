"""Event log analytics on Spark: an append-only event log, folds over it, read models, rules and a corpus toolkit."""
