"""The operators of a request, by category. Each category has a registry of factories by operator name."""
