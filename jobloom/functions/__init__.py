"""Column -> Column building blocks; no DataFrame is touched here."""
