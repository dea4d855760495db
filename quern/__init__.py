"""Fact-and-rule analytics on Spark: schema-parameterised operators, rules and scores."""

__version__ = "0.1.0"
