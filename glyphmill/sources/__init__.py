"""Reading and writing tables, configurations and side files."""
