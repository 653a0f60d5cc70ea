"""lacre: finding, classifying, redacting and auditing personal data on Spark."""
