"""The registered model queries ask for the whole job; the classifiers themselves are not fitted here."""

import pytest

from lumiframe.catalog import model_queries as m
from lumiframe.constants import CV_FOLDS
from lumiframe.plans.experiment import Effort
from lumiframe.plans.prepare import Preparation
from lumiframe.plans.spaces import GRIDS, grid_trials


class Asked(Exception):
    """Carries what a query asked for."""


def asked(spark, data, monkeypatch, name, of):
    def stop(*args, **named):
        raise Asked(args, named)

    monkeypatch.setattr(m, of, stop)
    with pytest.raises(Asked) as found:
        getattr(m, name)(spark, data)
    return found.value.args


@pytest.mark.parametrize(
    "name,model",
    [
        ("random_forest_search", "random_forest"),
        ("decision_tree_search", "decision_tree"),
        ("neural_network_search", "mlp_classifier"),
        ("boosted_trees_search", "xgboost"),
        ("model_back_projection", "random_forest"),
        ("search_inside_folds", "decision_tree"),
    ],
)
def test_searches_are_whole(spark, data, monkeypatch, name, model):
    args, named = asked(spark, data, monkeypatch, name, "search")
    assert args[1:] == (model, grid_trials(model)) and named["folds"] == CV_FOLDS
    assert named.get("inside", Preparation()) == Preparation()


@pytest.mark.parametrize("name,models,settings", [("experiment", set(GRIDS), 24), ("predictions", {"decision_tree", "random_forest"}, 2)])
def test_experiments_are_whole(spark, data, monkeypatch, name, models, settings):
    args, _ = asked(spark, data, monkeypatch, name, "run_experiment")
    lists = args[3].head().asDict()
    assert set(lists["model_types_to_train"]) == models and lists["n_components"] == [Preparation().n_components]
    assert len(lists["searchs_hipermetrics"]) * len(lists["model_types_to_train"]) * len(lists["train_percentages"]) == settings
    assert args[5] == Effort()


def test_permuted_importance_has_the_full_arguments(spark, data, monkeypatch):
    args, _ = asked(spark, data, monkeypatch, "permuted_importance", "estimator_of")
    assert args[1]["maxIter"] == 3000 and args[1]["layers"][1:-1] == [100]
