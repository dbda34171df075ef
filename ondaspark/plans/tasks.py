"""Graphs of deferred calls with persisted outputs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

SKIPPED, TO_COMPUTE = "skipped", "to_compute"


@dataclass(eq=False)
class Deferred:
    """A call whose arguments may be other deferred calls. Called once in a computation, however many need it."""

    function: Callable
    name: str
    args: tuple = ()
    kwargs: dict = field(default_factory=dict)

    def inputs(self) -> list[Deferred]:
        return [a for a in (*self.args, *self.kwargs.values()) if isinstance(a, Deferred)]


def defer(function: Callable, names: str | list[str]) -> Callable:
    """A maker of deferred calls: one, or with several names one for each output of a shared call."""

    def make(*args, **kwargs):
        if isinstance(names, str):
            return Deferred(function, names, args, kwargs)
        shared = Deferred(function, f"__common__{'_'.join(names)}", args, kwargs)
        return tuple(Deferred(lambda out, i=i: out[i], n, (shared,)) for i, n in enumerate(names))

    return make


def compute(tasks: list[Deferred], persist: dict[str, str] | None = None, exists: Callable[[str], bool] = lambda _: False, read: Callable[[str], Any] | None = None, write: Callable[[str, Any], None] | None = None) -> list:
    """Values of tasks. An output whose name has a path in persist is read if it exists, and else written once computed."""
    persist, done = persist or {}, {}

    def value(t: Deferred):
        if id(t) not in done:
            path = persist.get(t.name)
            if path is not None and exists(path):
                done[id(t)] = read(path)
            else:
                take = lambda a: value(a) if isinstance(a, Deferred) else a
                out = t.function(*map(take, t.args), **{k: take(v) for k, v in t.kwargs.items()})
                if path is not None:
                    write(path, out)
                    out = read(path)
                done[id(t)] = out
        return done[id(t)]

    return [value(t) for t in tasks]


def status(tasks: list[Deferred], persist: dict[str, str] | None = None, exists: Callable[[str], bool] = lambda _: False) -> dict[str, str]:
    """What a computation would do with each name, without running anything: what only persisted outputs need is skipped."""
    persist, out = persist or {}, {}

    def visit(t: Deferred, needed: bool) -> None:
        here = needed and not (t.name in persist and exists(persist[t.name]))
        if out.get(t.name) != TO_COMPUTE:
            out[t.name] = TO_COMPUTE if here else SKIPPED
        for x in t.inputs():
            visit(x, here)

    for t in tasks:
        visit(t, True)
    return out
