"""Frostline: PySpark analytics for perishable-shipment compliance data."""
