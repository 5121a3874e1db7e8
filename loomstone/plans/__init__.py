"""Registered queries, by subject, with their SQL counterparts."""
