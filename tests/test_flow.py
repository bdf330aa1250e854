import threading
import time

import pytest

from labelloom.plans import flow as F


def diamond() -> F.Flow:
    f = F.Flow("diamond")
    a, b, c, d = f.add("a", lambda x: x + 1), f.add("b", lambda x: x * 2), f.add("c", lambda x: x * 3), f.add("d", lambda x, y: x + y)
    f.start_with(a, F.Input("ip_data"))
    f.connect(a, b, a.value())
    f.connect(a, c, a.value())
    f.connect([b, c], d, b.value(), y=c)
    f.output = d.value()
    return f


def test_diamond():
    f = diamond()
    assert f.run(ip_data=1) == 10 and f.run(ip_data=2) == 15
    f.output = f.steps[3].value(lambda x: -x)
    assert f.run(ip_data=1) == -10


def test_callbacks_records_and_mocks():
    f, seen = diamond(), []
    f.steps[0].on_done(lambda out: seen.append((out, f.steps[0].output)))
    f.record = {}
    f.mock("c", lambda x: 100)
    assert f.run(ip_data=1) == 104 and seen == [(2, None)] and f.record["d"] == ((4,), {"y": 100})


@pytest.mark.parametrize("broken", ["no start", "cycle", "orphan", "two starts", "name", "input"])
def test_validation(broken):
    f = diamond()
    with pytest.raises(F.FlowError):
        if broken == "no start":
            f.start = None
        elif broken == "cycle":
            f.connect(f.steps[3], f.steps[1])
        elif broken == "orphan":
            f.add("e", print)
        elif broken == "two starts":
            f.start_with(f.steps[1])
        elif broken == "name":
            f.add("a", print)
        f.run(**({} if broken == "input" else {"ip_data": 1}))


def test_first_failure_ends_the_flow():
    f = diamond()
    f.mock("b", lambda x: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        f.run(ip_data=1)
    assert f.steps[1].state is F.State.FAILED and f.steps[3].state is F.State.NOT_STARTED


def test_independent_steps_run_side_by_side():
    f, gate = diamond(), threading.Barrier(2, timeout=5)
    f.mock("b", lambda x: gate.wait() and 0 or 1)
    f.mock("c", lambda x: gate.wait() and 0 or 1)
    assert f.run(ip_data=1) == 2


def test_many_items():
    def make() -> F.Flow:
        f = F.Flow("one")
        s = f.add("s", lambda x: (time.sleep(0.01 * (x % 3)), x * x)[1])
        f.start_with(s, F.Input("ip_data"))
        f.output = s.value()
        return f

    assert list(F.operate(make(), range(4))) == [0, 1, 4, 9]
    assert list(F.operate_in_parallel(make, range(40), 4)) == [x * x for x in range(40)]
    with pytest.raises(TypeError):
        list(F.operate_in_parallel(make, [1, "x", 2], 2))


def test_helpers():
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert F.retried(flaky, wait_s=0)() == "ok" and F.batches(list(range(23)), 10)[-1] == [20, 21, 22]
    with pytest.raises(F.FlowError):
        F.checked_size(bytes(2 << 20))


def test_frames_as_values(spark):
    f = F.Flow("frames")
    a = f.add("load", spark.range)
    b = f.add("filter", lambda df, n: df.where(f"id % {n} = 0"))
    f.start_with(a, F.Input("ip_data"))
    f.connect(a, b, a.value(), 3)
    f.output = b.value(lambda df: df.count())
    assert f.run(ip_data=10) == 4
