"""Unbounded sources: the engine is a batch engine and has no operators here."""
