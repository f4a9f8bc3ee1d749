"""The ledger as a stream: answer what is new, in batches that can be run again."""
