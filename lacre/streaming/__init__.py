"""Job state over streams of events."""
