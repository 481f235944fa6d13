"""Whole plans: the registered queries over the driver's tables, and the commands (compare, inspect, audit, remap, query)."""
