"""Pattern tables and scalar column functions."""
