"""Operators for text corpora; nothing outside this folder imports them."""
