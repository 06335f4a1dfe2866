"""DataFrame operators: totals, ranks, distributions, comparison, schedule."""
