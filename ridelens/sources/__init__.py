"""ridelens.sources."""
