"""Column functions: calendar, variance measures and rates."""
