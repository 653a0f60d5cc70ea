"""DataFrame operators: detection, resolution, policy, redaction, verification, review, layout."""
