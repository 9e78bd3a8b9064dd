"""Quality floors of the reference's model test, on the cohort binding:
forest, held-out stratified 20 %, ROC-AUC > .70, at-risk AP > .65,
at-risk recall > .55, refill ratio the top feature."""
from cohort_engine.operators import metrics, models
from cohort_engine.plans import modeling

from places import SF01


def test_forest_floors(spark):
    m = modeling.fitted(spark, SF01, "Random Forest")
    _, test = modeling.train_test(spark, SF01)
    r = metrics.model_metrics(models.score(m, test, "patient_id", name="rf"), digits=None).first()
    assert r["roc_auc"] > 0.70
    assert r["pr_auc_at_risk"] > 0.65
    assert r["at_risk_recall"] > 0.55
    top = models.feature_importance(spark, m, top=1).first()
    assert top["feature"] == "refill_ratio"
