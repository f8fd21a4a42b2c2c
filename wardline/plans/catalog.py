"""Registered queries over the driver's tables, and their oracle SQL."""

from __future__ import annotations

from wardline.plans import fleetwide, operations, readside, tracks, vehicles

MODULES = (tracks, readside, vehicles, fleetwide, operations)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE = {k: v for m in MODULES for k, v in m.ORACLE.items()}
