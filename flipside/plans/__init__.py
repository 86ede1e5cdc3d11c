"""The five investigations, each composed from the operators."""
