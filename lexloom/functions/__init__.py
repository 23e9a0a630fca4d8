"""Part of lexloom; see the README for the map of the package."""
