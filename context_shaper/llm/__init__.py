"""Operators for preparing training data: filtering, de-duplication, mixing and archives."""
