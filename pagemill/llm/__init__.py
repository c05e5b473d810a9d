"""Operators over the text of a training corpus. Nothing else in the library imports this subpackage."""
