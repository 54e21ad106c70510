"""Relational, sequence, geometry and scoring operators."""
