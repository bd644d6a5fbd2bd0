"""Plan shapes that need more than one built-in operator: running totals, quantiles, paired tests."""
