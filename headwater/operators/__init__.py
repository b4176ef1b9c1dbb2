"""Declarative operators on links, shelters, requests and references."""
