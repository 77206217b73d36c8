"""Reading and writing tables, catalogs, templates and settings."""
