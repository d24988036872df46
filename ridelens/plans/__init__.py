"""ridelens.plans."""
