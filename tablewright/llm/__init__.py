"""Operators for cleaning and preparing training data; nothing else in the library imports them."""
