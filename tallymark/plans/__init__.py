"""Whole comparisons: planning, running, explaining."""
