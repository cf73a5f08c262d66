"""Queries of the point-cloud operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from cloudloom.jobs import cloud_queries, cluster_queries, image_queries, name_queries, neighbor_queries, normal_queries, shape_queries

MODULES = (cloud_queries, neighbor_queries, cluster_queries, image_queries, name_queries, normal_queries, shape_queries)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
