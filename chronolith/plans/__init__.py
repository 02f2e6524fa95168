"""Adapters, the query catalogue and its SQL."""
