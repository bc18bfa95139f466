"""Queries of the engine and, where SQL can state them, the same in plain SQL."""
