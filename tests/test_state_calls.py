"""what a key of the running contradictions costs: state calls and frames, not its rows."""

import random

import pandas as pd

from graphloom.streaming import stateful


class Value:
    def __init__(self):
        self.value, self.calls = None, []

    def exists(self):
        self.calls.append("exists")
        return self.value is not None

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value


class Handle:
    def __init__(self):
        self.values = {}

    def getValueState(self, name, *_):
        return self.values.setdefault(name, Value())

    def getListState(self, *_):
        return None


def frames_of(rows, size):
    columns = ["subject", "predicate", *stateful.FACT, "state"]
    return [pd.DataFrame(rows[i : i + size], columns=columns) for i in range(0, len(rows), size)]


def test_a_key_costs_two_state_calls_and_one_frame():
    processor, handle = stateful._Firsts(None), Handle()
    processor.init(handle)
    rows = [(1, "p", i, "ab"[i % 2], None if i % 3 else 0.5, i, "Accepted") for i in range(12)]
    out = list(processor.handleInputRows((1, "p"), iter(frames_of(rows, 1)), None))
    assert len(out) == 1 and len(out[0]) == 11
    calls = [c for v in handle.values.values() for c in v.calls]
    assert sorted(calls) == ["get", "update"]
    later = [(1, "p", 50, "a", 0.5, 50, "Accepted")]
    out = list(processor.handleInputRows((1, "p"), iter(frames_of(later, 1)), None))
    assert out[0][["old_id", "new_id"]].to_numpy().tolist() == [[1, 50]]
    assert [c for v in handle.values.values() for c in v.calls].count("update") == 1


def test_pairs_equal_a_plain_loop():
    for seed in range(60):
        rnd = random.Random(seed)
        processor, known, got, want = stateful._Firsts(None), [], [], []
        processor.init(Handle())
        for batch in range(3):
            rows = [(1, "p", batch * 20 + i, rnd.choice(["a", "b", "c", None]), rnd.random(), rnd.choice([None, *range(8)]), rnd.choice(["Accepted", "Superseded"])) for i in range(rnd.randrange(1, 15))]
            known += [r for r in rows if r[6] == "Accepted" and r[3] is not None and r[5] is not None]
            firsts = []
            for r in sorted(known, key=lambda r: (r[5], r[2])):
                if not firsts or (len(firsts) == 1 and r[3] != firsts[0][3]):
                    firsts.append(r)
            known = firsts
            for r in rows:
                old = next((f for f in firsts if f[3] != r[3]), None)
                if r[3] is not None and r[5] is not None and old and (old[5], old[2]) < (r[5], r[2]):
                    want.append((old[2], r[2]))
            for frame in processor.handleInputRows((1, "p"), iter(frames_of(rows, 4)), None):
                got += [tuple(x) for x in frame[["old_id", "new_id"]].to_numpy().tolist()]
        assert sorted(got) == sorted(want)
