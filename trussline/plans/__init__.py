"""Declarative plans: the filter language and scratch tables."""
