"""Registered queries: each operator run on the given tables, with the SQL that gives the same rows."""

from latticework.catalog import cells, joins, lattices, modelling, ranking, runs, sampling

MODULES = [cells, joins, ranking, sampling, runs, lattices, modelling]


def queries():
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
