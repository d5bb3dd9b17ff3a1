"""The search fits what it drew."""

import pytest

from tidemark.plans import catalogue, search

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("number", range(3))
def test_models_are_fitted_at_the_drawn_settings(monkeypatch, number):
    seen = {}
    keep = lambda name: lambda y, *a, **b: seen.update({name: (a, b)})
    monkeypatch.setattr(catalogue.factors, "fit_wmf", keep("wmf"))
    monkeypatch.setattr(catalogue.factors, "fit_cofactor", keep("cofactor"))
    monkeypatch.setattr(catalogue.lightgcn, "fit", keep("lightgcn"))
    monkeypatch.setattr(catalogue.lightgcn, "factors_of", lambda x: x)
    monkeypatch.setattr(catalogue.rules, "full_signal", lambda y, *a: a)
    drawn = search.samples(3)[number]
    for model in ("wmf", "cofactor", "lightgcn"):
        catalogue.fit_model(None, model, drawn[model])
    assert seen["wmf"][1]["sweeps"] == drawn["wmf"]["n_sweeps"] and seen["cofactor"][1]["sweeps"] == drawn["cofactor"]["n_sweeps"]
    assert seen["lightgcn"][0][4] == drawn["lightgcn"]["epochs"] and seen["lightgcn"][1]["batch_size"] == 2048
    catalogue.fit_model(None, "signal_wmf", drawn["signal_wmf"])
    assert seen["wmf"][1]["signal"][1:3] == (drawn["signal_wmf"]["k_user"], drawn["signal_wmf"]["k_item"])


def test_ten_rounds_of_all_fitted_models(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "random_search", lambda spark, name, score, models, rounds: (models, rounds))
    assert catalogue.QUERIES["wmf_search"](spark, SF) == (("wmf", "signal_wmf", "cofactor", "lightgcn"), 10)


def test_the_search_scores_every_model(spark, monkeypatch):
    """Forty fits are too many for a test: here each model is fitted once, over literal feedback, with few sweeps and epochs."""
    one = {"latent": 2, "lambda_rate": 0.1, "n_sweeps": 1, "alpha": 5.0, "random_state": 42}
    drawn = {"wmf": one, "signal_wmf": one | {"normalize": "row_max", "gamma": 0.5, "k_user": 1, "k_item": 1, "min_support": 0.0, "min_confidence": 0.0, "min_lift": 0.0}, "cofactor": one | {"gamma": 1.0, "lambda_context_rate": 0.1, "negative_samples": 1}, "lightgcn": {"latent": 2, "n_layers": 1, "learning_rate": 0.01, "lambda_rate": 1e-4, "epochs": 1, "batch_size": 4, "random_state": 42}}
    monkeypatch.setattr(search, "samples", lambda rounds, seed: [drawn])
    log = spark.createDataFrame([(u, i, n, 5.0) for n, (u, i) in enumerate((u, i) for i in range(6) for u in range(6) if u != i)], "userid long, itemid long, ts long, rating double")
    monkeypatch.setattr(catalogue, "_log", lambda spark, sf_dir: log)
    rows = catalogue.QUERIES["wmf_search"](spark, SF).collect()
    assert [r.model for r in rows] == ["wmf", "signal_wmf", "cofactor", "lightgcn"] and all(0 <= r.score <= 1 for r in rows)
