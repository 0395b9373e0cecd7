"""Typed readers and writers, and the binding of the supplied tables to the data model."""
