"""Search methods by name: each looks for a feature subset of small cost.

A method is called as ``method(task, options)`` and returns a ``Found``. All
state is a population of N positions over d features, small at any data size;
only scoring touches data, one batch of masks at a time, through ``task.score``.
"""

from __future__ import annotations

from maskforge.plans.search.base import Found, LocalScorer, Options, SparkScorer, Task, scorer_for

METHODS: dict = {}


def method(*names: str, **fixed):
    """Registers a method under names, with options that it always takes."""

    def add(run):
        for name in names:
            METHODS[name] = (run, fixed)
        return run

    return add


def search(name: str, task: Task, options: Options | None = None) -> Found:
    """Runs a method; unknown names raise KeyError, options are never changed."""
    run, fixed = METHODS[name]
    options = (options or Options()).replace(**fixed)
    return run(task.prepared(options), options)


from maskforge.plans.search import interval, rankings, single, staged, swarms  # noqa: E402, F401

__all__ = ["METHODS", "Found", "LocalScorer", "Options", "SparkScorer", "Task", "method", "scorer_for", "search"]
