"""The ordered command log."""
