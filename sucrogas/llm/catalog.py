"""Registered queries of the subpackage with their SQL twins."""

from sucrogas.llm import queries

QUERIES = {**queries.QUERIES}
SQL = {**queries.SQL}
