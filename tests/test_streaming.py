from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF


def test_stream_scoring_equals_batch(spark):
    s = E.queries()["st_stream_scoring"](spark, SF)
    b = E.queries()["j3_score_validation"](spark, SF)
    assert sorted(s.collect()) == sorted(b.collect())


def test_stream_metrics_equal_batch(spark):
    from sparkselect.functions.metrics import classification_metrics
    s = E.queries()["st_stream_running_metrics"](spark, SF).first().asDict()
    from sparkselect.plans.catalog_curves import _nb_model
    from sparkselect.plans.common import assemble, finish
    from sparkselect.plans.tasks import t1_events
    t = assemble(t1_events(spark, SF), ["value", "k", "h"])
    model = _nb_model(spark, SF)
    b = finish(classification_metrics(model.transform(t), "y", "prediction")).first().asDict()
    assert s == b
