"""Registered queries: the operators over the given tables, each beside its SQL oracle."""
