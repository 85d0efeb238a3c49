"""Whole-warehouse runs that chain the operators."""
