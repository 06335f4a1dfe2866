"""Operators that prepare training text: ordering, filtering, copies, mixing, formatting."""
