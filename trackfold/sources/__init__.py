"""Reading and writing: JSON lines, artifacts, motion capture, and intermediate tables."""
