"""Embedding and random-walk analytics as DataFrame operators."""
