"""Dataset operators: search, splits, metrics, calibration, events."""
