"""Live tracking of a fit as streams, and the same results over tables."""
