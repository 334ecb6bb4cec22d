"""Operators on whole tables: dataflow, task commands, the call cache, the run ledger and output assertions."""
