"""sparkselect: classifier selection on Spark tables.

Profiling, leak-free splits, preparation, a menu of fourteen classifiers,
cross-validation, tuning, ensembles, metric tables, diagnostics and fairness,
all as Spark DataFrames and ``pyspark.ml`` stages.

Main entry points::

    from sparkselect.plans.auto import AutoConfig, run, setup
    from sparkselect.operators.profile import profile
    from sparkselect.operators.models import make_estimator, MENU
    from sparkselect.functions.metrics import classification_metrics, metric_table
"""

from sparkselect.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
