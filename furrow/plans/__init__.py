"""Whole dataflows, from sources to reports."""
