"""Regime models of many series."""
