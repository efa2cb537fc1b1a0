"""Incremental counterparts, an extension."""
