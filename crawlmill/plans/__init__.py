"""Staged transforms and registered queries."""
