"""Compositions of operators: layers, severity scores, policy runs."""
