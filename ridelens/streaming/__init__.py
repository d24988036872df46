"""ridelens.streaming."""
