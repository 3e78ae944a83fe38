"""Composed plans: the flagship bar plan, declarative steps, registered queries."""
