"""Stateful streaming redaction."""
