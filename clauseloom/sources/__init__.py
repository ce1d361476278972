"""Reading and writing minutes, tables, vectors and models."""
