"""Operators on span columns: extraction, masking, redaction, vaults, decoding, evaluation."""
