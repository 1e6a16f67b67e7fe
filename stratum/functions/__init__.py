"""Part of the stratum ledger engine."""
