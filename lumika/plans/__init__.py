"""The catalog queries, by family."""

MODULES = ("timeline", "catalog", "groups", "flows", "passes")
