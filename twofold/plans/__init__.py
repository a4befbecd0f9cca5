"""Composed analyses: the stages of an ensemble study and the named queries."""
