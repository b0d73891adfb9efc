"""Incremental panels."""
