"""Models, their evaluation and their interpretation."""
