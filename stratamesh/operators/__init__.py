"""Operators on meshes and cells: joins, adaptation, remapping, halos, fields, aggregates."""
