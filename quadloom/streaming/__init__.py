"""Stateful tile arrival."""
