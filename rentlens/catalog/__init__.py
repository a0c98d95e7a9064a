"""Registered queries and the SQL they are checked against."""

from rentlens.catalog import cleaning, market, modelling, statistics

_PARTS = (cleaning, statistics, market, modelling)


def queries():
    return {name: query for part in _PARTS for name, query in part.QUERIES.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
