"""Operators of the array model, each a function of DataFrames.

Long form: one row for each (s, c, p, l) with a value.  Dense form: the
wavelength axis as an array column.
"""
