"""A session of an ordered stream reads and writes its state once a batch, however many turns wait."""

from turnlens.streaming import sessions


class Handle:
    def __init__(self):
        self.calls, self.kept, self.timers = 0, None, set()

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, *schema):
        return self

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls += 1
        self.kept = value

    def updateValue(self, key, value):
        self.calls += 1

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)


def test_state_calls_do_not_grow_with_the_turns():
    handle, fold = Handle(), sessions.Fold(1000)
    fold.init(handle)
    row = lambda k: ("Assistant", k, 1, False, False, [], [], [])
    assert not list(fold.passed("s", {k: row(k) for k in range(1, 500)}, False))
    assert handle.calls <= 4 and handle.timers == {499}
    (out,) = fold.passed("s", {0: row(0)}, False)
    assert handle.calls <= 8 and handle.timers == set()
    assert out["n_turns"].tolist() == [500] and out["current_streak"].tolist() == [500]


def test_state_calls_do_not_grow_with_the_sessions():
    """Sessions of one bucket, also one without a key, share a read, a write and a timer; a timer lets those pass whose newest turn is behind it."""
    handle, fold = Handle(), sessions.Fold(1000)
    fold.init(handle)
    row = lambda ms: ["Assistant", ms, 1, False, False, None, None, []]
    keys = [*(f"s{k}" for k in range(100)), None]
    assert fold.step({key: {2: row(10 + k)} for k, key in enumerate(keys)}, None) == []
    assert handle.calls == 3 and handle.timers == {10}
    handle.timers.clear()
    assert [r[0] for r in sorted(fold.step({}, 12))] == ["s0", "s1"] and handle.timers == {12}
    out = fold.step({key: {k: row(1) for k in range(2)} for key in keys}, None)
    assert handle.calls == 9 and handle.timers == set()
    assert {r[0]: r[-1] for r in out} == dict.fromkeys(keys[2:], 3)
