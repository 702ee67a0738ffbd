"""Column functions: text normalising, tokens, keys, dates, parsers."""
