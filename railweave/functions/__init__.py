"""Column functions: text, dates and geography."""
