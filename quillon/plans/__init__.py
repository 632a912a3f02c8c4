"""Requests as data, and the catalogue of registered queries."""
