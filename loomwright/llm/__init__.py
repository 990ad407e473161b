"""Training-data operators. Nothing else in this library imports this subpackage."""
