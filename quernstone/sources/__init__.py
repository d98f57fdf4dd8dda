"""Readers that turn foreign formats into the tables of the data model."""
