"""Registered queries of the sensor operators; importing the modules fills tessera.catalog."""

from tessera.queries import bags, clouds, geometry, motion, places, sources, streams, vision  # noqa: F401
