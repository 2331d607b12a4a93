"""Requests over a graph store: each is one plan, answered in an envelope."""
