"""A small table is one partition, however many rows it has: what is parsed row by row is dealt to all tasks."""

import pytest

from tessera.plans import projects, tasks, texts
from tests.oracle import SF

MADE = {
    "scan_edges, scan_symbols": texts._sources,
    "contract_drift": texts._models,
    "function_complexity": texts._functions,
    "resolve_calls and all of projects": projects.project_files,
    "data_flow": projects._flowing,
    "resolve_aliases": projects._tree,
    "api_contracts": lambda spark, sf: tasks.contract_tables(spark, sf)[0],
}


@pytest.mark.parametrize("name", MADE)
def test_files_are_dealt_to_all_tasks(spark, name):
    files = MADE[name](spark, SF)
    filled = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(n > 0 for n in filled) >= spark.sparkContext.defaultParallelism
