"""Changes of tables as plans."""
