import json

import pytest

from quillfind import config
from quillfind.plans.pipelines import REGISTRY


def test_round_trip_and_overrides(tmp_path):
    c = config.with_overrides(config.Experiment(), **{"retrieval.top_k": 5, "seed": 7})
    assert c.retrieval.top_k == 5 and c.seed == 7 and c.chunking == config.Chunking()
    config.save(c, str(tmp_path / "c.json"))
    assert config.load(str(tmp_path / "c.json")) == c
    for odd in ({"unknown": 1}, {"retrieval": {"topk": 5}}):
        with pytest.raises(ValueError, match="has no settings"):
            config.from_dict(odd)
    with pytest.raises(ValueError, match="settings"):
        config.with_overrides(config.Experiment(), **{"retrieval.topk": 5})
    with pytest.raises(ValueError, match="settings"):
        config.with_overrides(config.Experiment(), **{"retriever.top_k": 5})
    assert json.loads((tmp_path / "c.json").read_text())["retrieval"]["rrf_k"] == 60


def test_validation():
    config.Experiment().validate(set(REGISTRY))
    for name, value in {"retrieval.top_k": 0, "clustering.soft_threshold": 1.0, "chunking.chunk_overlap": 200, "max_docs": 0, "evaluation.alpha": 0}.items():
        with pytest.raises(ValueError):
            config.with_overrides(config.Experiment(), **{name: value}).validate()
    with pytest.raises(ValueError, match="unknown pipelines"):
        config.with_overrides(config.Experiment(), pipelines=["nope"]).validate(set(REGISTRY))
