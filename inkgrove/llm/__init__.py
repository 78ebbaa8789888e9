"""Operators for texts of training data. Nothing outside of this subpackage imports it."""
