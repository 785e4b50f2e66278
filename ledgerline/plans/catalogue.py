"""Registered queries over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, audit_oracle, bindings, certify_bindings, domain, fault_bindings, intake_bindings, release_bindings, seed_bindings, storage_bindings

Query = Callable[[SparkSession, str], DataFrame]


def _audit(name: str) -> Query:
    return lambda spark, sf_dir: audit.CATALOGUE[name].run(domain.tables(spark, sf_dir), audit.DEFAULTS)


QUERIES: dict[str, Query] = bindings.QUERIES | release_bindings.QUERIES | intake_bindings.QUERIES | seed_bindings.QUERIES | fault_bindings.QUERIES | certify_bindings.QUERIES | storage_bindings.QUERIES
ORACLE_SQL: dict[str, str] = bindings.ORACLE_SQL | release_bindings.ORACLE_SQL | intake_bindings.ORACLE_SQL | seed_bindings.ORACLE_SQL | fault_bindings.ORACLE_SQL | certify_bindings.ORACLE_SQL | storage_bindings.ORACLE_SQL
for _name in audit.CATALOGUE:
    QUERIES[f"audit_{_name}"] = _audit(_name)
    ORACLE_SQL[f"audit_{_name}"] = domain.oracle(audit_oracle.SQL[_name])
