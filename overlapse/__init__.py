"""Relation-typed corpus audits on Spark."""
