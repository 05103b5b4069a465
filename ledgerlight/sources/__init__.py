"""Readers, incremental pulls, versioned tables and the adapters to the driver's tables."""
