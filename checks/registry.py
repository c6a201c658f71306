"""All registered queries and SQL twins."""

from checks import changelogs, fingerprints, manifests, releases, run_log, streams, task_graph

_MODULES = [run_log, task_graph, manifests, fingerprints, releases, changelogs, streams]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
