"""Orbital, relativistic, oceanographic and military functions as Column expressions (SI units)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.geo import EARTH_RADIUS, _c, destination_spherical

# Gravitational constant, speed of light, earth mass, standard gravity, radar refraction factor.
G = 6.6743e-11
LIGHT = 299792458.0
EARTH_MASS = 5.972e24
GRAVITY = 9.80665
RADAR_K = 4 / 3


def orbital_velocity(r, m) -> Column:
    return F.sqrt(G * _c(m) / _c(r))


def orbital_period(r, m) -> Column:
    return 2 * math.pi * F.sqrt(F.pow(_c(r), 3) / (G * _c(m)))


def escape_velocity(r, m) -> Column:
    return F.sqrt(2 * G * _c(m) / _c(r))


def hohmann(r1, r2, m=EARTH_MASS) -> Column:
    """array of both velocity changes of a transfer between circular orbits."""
    r1, r2, mu = _c(r1), _c(r2), G * _c(m)
    first = F.sqrt(mu / r1) * (F.sqrt(2 * r2 / (r1 + r2)) - 1)
    second = F.sqrt(mu / r2) * (1 - F.sqrt(2 * r1 / (r1 + r2)))
    return F.array(first, second)


def lorentz(v) -> Column:
    """Lorentz factor; null at and above the speed of light."""
    v = _c(v)
    return F.when(F.abs(v) < LIGHT, 1 / F.sqrt(1 - (v / LIGHT) * (v / LIGHT)))


def time_dilation(v) -> Column:
    """Coordinate over proper time, which is at least 1."""
    return lorentz(v)


def gps_correction(altitude, v) -> Column:
    """Nanoseconds a second that a clock gains: gravitational blue shift less velocity."""
    mu = G * EARTH_MASS
    general = mu / LIGHT**2 * (1 / EARTH_RADIUS - 1 / (EARTH_RADIUS + _c(altitude)))
    return (general - _c(v) * _c(v) / (2 * LIGHT**2)) * 1e9


def sound_speed(t, s, d) -> Column:
    """Mackenzie's nine-term equation of 1981: temperature in C, salinity in parts per thousand, depth in m."""
    t, s, d = _c(t), _c(s), _c(d)
    return 1448.96 + 4.591 * t - 5.304e-2 * t * t + 2.374e-4 * t * t * t + 1.340 * (s - 35) + 1.630e-2 * d + 1.675e-7 * d * d - 1.025e-2 * t * (s - 35) - 7.139e-13 * t * d * d * d


def drift(lat, lon, speed, bearing, hours) -> Column:
    """array(lat, lon) after drifting by dead reckoning."""
    return destination_spherical(lat, lon, bearing, _c(speed) * 3600.0 * _c(hours))


def radar_horizon(antenna, target) -> Column:
    return math.sqrt(2 * RADAR_K * EARTH_RADIUS) * (F.sqrt(_c(antenna)) + F.sqrt(_c(target)))


def ballistic_range(v, angle) -> Column:
    return _c(v) * _c(v) * F.sin(2 * F.radians(_c(angle))) / GRAVITY
