"""DataFrame operators: joins, windows, filters, merges, audits, selection."""
