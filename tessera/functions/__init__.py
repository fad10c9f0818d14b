"""Tessera subpackage."""
