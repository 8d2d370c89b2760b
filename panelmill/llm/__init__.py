"""Operators for language-model data; nothing outside this folder imports it."""
