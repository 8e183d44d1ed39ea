"""strata: cohort analytics on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` built from the
DataFrame / SQL API, so Catalyst and AQE plan it.  Sub-packages:

* ``functions``  column expressions and exact statistics (null rules live here)
* ``sources``    readers, writers, inventory checks
* ``operators``  selection, joins, aggregation, windows, longitudinal,
                 imputation, scaling, features, risk, quality, images, ML
* ``plans``      multi-step compositions (integration)
* ``llm``        training-data operators (optional; nothing else imports it)
* ``catalog``    bindings of the operators onto the benchmark tables
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers (on any
    node, from any working directory) run grouped-pandas and vectorised UDF
    code without needing the package installed there."""
    import sys
    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # noqa: BLE001 - older cloudpickle: workers then import the package
        pass


_ship_by_value()
