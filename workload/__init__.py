"""Registered queries with their SQL cross-checks."""

from workload import compaction, documents, lookups, runs, streams, views, writes

MODULES = [views, lookups, writes, compaction, documents, runs, streams]
