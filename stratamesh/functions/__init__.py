"""Scalar functions over columns: spatial keys, geometry, equations of state, fluxes, interface geometry, material sets."""
