"""Requests: validation, and the pipeline of one request, of chains and of batches."""
