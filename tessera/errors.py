"""Errors raised while a plan is built. Rows that cannot be computed become null instead."""

from __future__ import annotations


class SensorError(Exception):
    """Base of all errors of this package."""


class SensorNotFoundError(SensorError, KeyError):
    """A sensor name is unknown."""


class BagError(SensorError, RuntimeError):
    """A bag file is damaged, or used after closing."""


class CalibrationError(SensorError, ValueError):
    """A calibration or parameter is impossible."""
