"""corpuscope — label-corpus audits on PySpark."""

from __future__ import annotations


def _ship_code_with_tasks() -> None:
    """Pickle this package's functions by value in Spark's closures.

    Pandas UDFs and ``applyInPandas`` kernels call helpers of this package on
    the executors.  Registering the package with PySpark's cloudpickle sends
    that code along with each task, so executors (and local Python workers
    started from another directory) need no installed copy of the package.
    """
    try:
        import sys

        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 — older cloudpickle: fall back to by-reference pickling
        pass


_ship_code_with_tasks()
