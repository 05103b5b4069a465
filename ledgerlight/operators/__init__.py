"""Generic DataFrame operators the domain plans are composed from."""
