"""Claim-verification analytics expressed as Spark DataFrame plans."""
