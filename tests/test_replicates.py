"""The bootstrap queries draw as many replicates as the operator's default."""

import inspect
from unittest.mock import MagicMock

import pytest

from tessera.operators import evaluation as ev
from tessera.plans import audit_queries, pair_queries


@pytest.mark.parametrize("module, name, operator", [(pair_queries, "bootstrap_ci", "bootstrap_interval"), (audit_queries, "paired_bootstrap", "paired_interval")])
def test_replicates(spark, monkeypatch, module, name, operator):
    drawn, signature = [], inspect.signature(getattr(ev, operator))

    def fake(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        drawn.append(bound.arguments["reps"])
        return MagicMock(columns=[])

    monkeypatch.setattr(ev, operator, fake)
    monkeypatch.setattr(ev, "entity_counts", MagicMock())
    monkeypatch.setattr(audit_queries.dec, "accept", MagicMock())
    monkeypatch.setattr(pair_queries, "accepted_counts", lambda *_: (None,) * 5)
    monkeypatch.setattr(audit_queries, "scored_pairs", lambda *_: (MagicMock(), None, MagicMock(), MagicMock()))
    getattr(module, name)(spark, "")
    assert drawn == [1000]
