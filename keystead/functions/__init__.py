"""Validators and column transforms."""
