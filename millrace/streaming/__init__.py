"""Incremental click counts as a structured stream: an addition, which batch plans do not need."""
