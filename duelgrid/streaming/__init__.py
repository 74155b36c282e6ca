"""Incremental forms of the batch operators. They go beyond what a batch evaluation needs."""
