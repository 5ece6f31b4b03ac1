"""All registered queries and their SQL."""

from . import catalog, catalog_store, catalog_topology, oracles

QUERIES = {**catalog.QUERIES, **catalog_store.QUERIES, **catalog_topology.QUERIES}
ORACLES = {**oracles.ORACLES, **catalog_store.ORACLES, **catalog_topology.ORACLES}
