"""Preprocessing steps that learn on one table and apply to another."""
