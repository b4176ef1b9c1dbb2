"""Inputs: YAML configuration files and directory inventories."""
