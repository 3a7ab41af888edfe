import pytest

from notelake.functions.driver import Registry, Telemetry, detect_project
from notelake.operators import telemetry


def test_calls_become_tables(spark):
    now = [1000.0]

    def clock():
        now[0] += 0.5
        return now[0]

    t = Telemetry(clock=clock)

    @t.measured("work", {"k": "v"})
    def work(bad=False):
        with t.span("inner"):
            if bad:
                raise ValueError("no")
        return 7

    t.start_trace("trace")
    assert work() == 7
    with pytest.raises(ValueError):
        work(True)
    t.increment("n", 2)
    t.set_gauge("g", 1)
    t.change_gauge("g", 4)
    o = t.observations(spark)
    assert o.filter("name = 'work_duration_ms'").count() == 2
    assert telemetry.counters(o.filter("kind = 'counter'")).first().value == 2.0
    assert telemetry.gauges(o.filter("name = 'g'")).first().value == 5.0
    spans = t.spans(spark)
    assert [(r.operation, r.children) for r in telemetry.span_children(spans).filter("children > 0").collect()] == [("work", 1)] * 2
    assert {r.operation: r.errors for r in telemetry.trace_summary(spans).collect()} == {"work": 1, "inner": 1}
    t.clear()
    assert t.spans(spark).count() == 0


def test_registry_and_project(tmp_path):
    r = Registry()
    a = r.get(dict)
    assert r.get(dict) is a
    r.register(dict, {"x": 1})
    assert r.get(dict) == {"x": 1}
    r.reset()
    assert r.get(dict) == {}
    (tmp_path / ".git").mkdir()
    (tmp_path / "sub").mkdir()
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "thing"\n')
    p = detect_project(str(tmp_path / "sub"))
    assert p["name"] == "thing" and p["root"] == str(tmp_path) and len(p["id"]) == 12
