"""Column functions: strings, dates, quality, rules and JSON."""
