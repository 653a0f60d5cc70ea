"""Column builders: check digits, spans of matches, normalisation, masking."""
