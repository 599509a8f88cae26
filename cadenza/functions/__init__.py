"""Column functions: conversions, calendars, formatting, running power."""
