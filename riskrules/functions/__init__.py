"""Column expressions, size-checked joins, materialisation and global ranking."""
