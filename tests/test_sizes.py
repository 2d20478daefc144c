"""What must not grow with the input: tasks that get all rows, calls of Python for each key."""

import json

import pandas as pd
import pytest

from tidewater.queries import QUERIES
from tidewater.streaming import watch

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["python_tools", "script_tools", "shell_tools", "openapi_tools", "code_symbols", "go_symbols", "token_counter", "wordpiece", "imports"])
def test_python_runs_on_all_cores_over_a_table_of_one_file(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


class State:
    def __init__(self):
        self.get = None

    @property
    def exists(self):
        return self.get is not None

    def update(self, value):
        self.get = value


def test_paths_share_a_state_and_are_told_apart():
    state = State()
    frame = lambda *rows: pd.DataFrame(rows, columns=["snapshot", "path", "mtime", "size", "deleted"])
    ask = lambda *frames: [tuple(r) for f in watch._changes((0,), iter(frames), state) for r in f.itertuples(index=False)]
    assert ask(frame((0, "a", 1, 1, False), (0, "b", 1, 1, False))) == []
    assert ask(frame((2, "b", 1, 1, True), (1, "b", 2, 1, False)), frame((1, "a", 1, 1, False), (1, "c", 3, 3, False))) == [("b", "modified", 1), ("c", "created", 1), ("b", "deleted", 2)]
    assert ask(frame((3, "b", 1, 1, False), (3, "c", 3, 3, False), (3, "a", 1, 2, False))) == [("b", "created", 3), ("a", "modified", 3)]
    assert sorted(json.loads(state.get[0])) == [["a", 3, 1, 2, True], ["b", 3, 1, 1, True], ["c", 3, 3, 3, True]]
