"""Relational operators: detection, redaction, selection, policies, placeholders and HTTP messages."""
