"""remuneria: pay analytics as lazy Spark DataFrame operators.

Subpackages: ``functions`` (column expressions, rule sets), ``sources``
(readers, page extraction, driver-table bindings, sinks), ``operators``
(aggregations, ranks, grids, payroll, history), ``streaming`` (the
incremental history merge) and ``plans`` (the query catalogue).
"""

__version__ = "0.1.0"
