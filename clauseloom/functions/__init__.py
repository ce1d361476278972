"""Column expressions; nothing here moves rows."""
