"""Registered queries on the driver's tables and the SQL they are compared with."""
