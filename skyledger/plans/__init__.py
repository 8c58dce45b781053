"""Registered queries over the driver's test tables, each with its SQL twin."""
