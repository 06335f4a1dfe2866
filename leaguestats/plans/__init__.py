"""Whole workflows: season view, career records, schedule, refresh."""
