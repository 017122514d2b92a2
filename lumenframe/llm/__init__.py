"""Text-corpus operators for training-data pipelines.

One module per operator; ``registry`` lists the queries.  Nothing outside this
subpackage imports it.
"""
