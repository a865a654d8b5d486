"""DataFrame operators for tables, sheets, pages and rules."""
