"""Training-data operators; one module each, with its query and SQL. Nothing outside imports this subpackage."""
