"""The registered queries, each next to the SQL that checks it."""

from folioscope.catalog import maintenance, retrieval


def queries() -> dict:
    return {**retrieval.QUERIES, **maintenance.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**retrieval.SQL, **maintenance.SQL}
