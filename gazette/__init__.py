"""gazette: news-stream analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (parameters are
keyword arguments), so pipelines chain with ``df.transform(op, ...)`` and
Catalyst sees one logical plan end to end.
"""

import sys as _sys

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Python tasks (``mapInPandas``) run gazette helpers on the workers;
    pickling this package by value lets them run without gazette being
    installed or on the workers' path."""
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(_sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: ship with addPyFile instead
        pass


_ship_by_value()
