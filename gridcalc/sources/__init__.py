"""Where sheets come from, and dense row numbers."""
