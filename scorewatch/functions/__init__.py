"""Column expression builders; none of them moves rows."""
