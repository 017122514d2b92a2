"""Whole workflows: build the design tensor, fit the weights, report."""
