"""Registered queries: operators applied to the driver's tables through the adapters, with their SQL."""
