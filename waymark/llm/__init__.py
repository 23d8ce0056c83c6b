"""Training-data operators. Nothing outside this subpackage imports it, and it imports nothing from outside it."""
