"""ridelens.functions."""
