"""Operators that prepare text for training; the rest of the library never imports this subpackage."""
