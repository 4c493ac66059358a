import pytest

from grainmill import config


def test_strict():
    run = config.from_dict(config.Run, {"stages": [{"name": "a", "start_training_step": 1}], "batching": {"micro_batch_size": 2, "ranks": 4}, "train_steps": 9})
    assert run.batching.global_batch_size == 8 and run.batching.steps(100, 37) == 7
    with pytest.raises(ValueError):
        config.from_dict(config.Run, {"stages": [], "batching": {"micro_batch_size": 2, "ranks": 4}, "train_steps": 9, "more": 1})
    with pytest.raises(ValueError):
        config.from_dict(config.Run, {"stages": [{"name": "a", "start_training_step": 2}], "batching": {"micro_batch_size": 2, "ranks": 4}, "train_steps": 9})
    with pytest.raises(ValueError):
        run.batching.steps(10, 10)
    assert config.cache_key(a=1, b=2) == config.cache_key(b=2, a=1)
