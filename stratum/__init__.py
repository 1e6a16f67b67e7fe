"""Versioned-ledger analytics expressed as Spark DataFrame plans."""
