"""Brokerage money, trading and client analytics as Spark DataFrame plans."""
