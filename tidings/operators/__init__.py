"""Relational operators: ``DataFrame -> DataFrame``, no actions inside."""
