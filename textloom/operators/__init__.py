"""DataFrame operators. Each takes a DataFrame and returns one; no operator starts a job."""
