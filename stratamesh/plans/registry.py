"""Formula queries: one formula evaluated over Spark columns and written out as the SQL that states it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.algebra import Sql, SparkProgram, SqlProgram

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"{name} is there already")
        self.queries[name] = query
        if sql is not None:
            self.sql[name] = sql

    def formula(self, name: str, table: str, inputs: dict[str, str], ids: list[str], build) -> None:
        """``inputs``: SQL expressions of both dialects over a table; ``build``: takes a program and returns the output expressions."""
        every = {i: i for i in ids} | inputs

        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {n}" for n, e in every.items()])
            program = SparkProgram(df)
            outputs = build(program)
            return program.select(**{i: program.col(i) for i in ids}, **outputs)

        program = SqlProgram(f"(SELECT {', '.join(f'{e} AS {n}' for n, e in every.items())} FROM {table})")
        outputs = build(program)
        self.add(name, query, program.select(**{i: Sql(i) for i in ids}, **outputs))
