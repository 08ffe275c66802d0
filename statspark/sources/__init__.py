"""Readers, writers and stores of fitted parameters."""
