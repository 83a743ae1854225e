"""All registered queries and their SQL counterparts."""

from . import captions, documents, frames, replies, reports, runs, streams

MODULES = (runs, documents, captions, frames, replies, reports, streams)


def queries():
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
