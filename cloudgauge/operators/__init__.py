"""The two spatial joins."""
