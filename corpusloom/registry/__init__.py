"""All registered queries, by family."""

from corpusloom.registry import columns, core, generation, joins, ordering, parsing, plans, sources, statistics, streams  # noqa: F401


def queries():
    return dict(core.QUERIES)


def sql():
    return dict(core.SQL)
