"""Predicate sets and the registered queries."""
