"""Column functions: text cleaning, codecs, schedules and scalar formulas."""
