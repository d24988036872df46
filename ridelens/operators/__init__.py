"""ridelens.operators."""
