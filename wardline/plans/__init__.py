"""Whole plans composed of sources, operators and functions."""
