"""lumenfold: source-text policy, diagnostics, evidence and event-ledger analytics on PySpark."""
