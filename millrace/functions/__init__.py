"""See the README for the map of the package."""
