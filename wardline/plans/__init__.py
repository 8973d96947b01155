"""Whole plans: scans and the registered queries."""
