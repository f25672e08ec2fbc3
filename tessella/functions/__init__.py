"""The expression language, distribution functions, running totals and calendar columns."""
