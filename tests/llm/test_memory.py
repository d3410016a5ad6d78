"""What workers keep between tasks."""

from types import SimpleNamespace

from ridgework.llm import common


def test_workers_give_memory_back_at_the_end_of_a_task(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    df = SimpleNamespace(sparkSession=SimpleNamespace(conf=SimpleNamespace(get=lambda *_: "1b")), mapInArrow=lambda f, schema: f)
    run = common.mapped(df, lambda batches: (b + 1 for b in batches), "x long")([1, 2])
    assert next(run) == 2 and not given
    assert list(run) == [3] and given == [True]
