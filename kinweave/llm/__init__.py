"""Operators that prepare texts and names for training data; nothing outside this subpackage imports it."""
