"""Exact per-text kernels in plain Python, run inside Arrow batches where offsets must be exact."""
