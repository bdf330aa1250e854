"""Flows of named steps.

A step is any callable; its arguments are constants, the flow's inputs, other steps' outputs, or functions
of these. Steps that give DataFrames only build a plan: Spark runs it as one when the output is written.
Independent steps run side by side in threads, which matters for steps that start Spark jobs.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from enum import Enum
from typing import Any


class State(Enum):
    NOT_STARTED = "not started"
    RUNNING = "running"
    DONE = "done"
    FAILED = "failed"


class FlowError(Exception):
    pass


@dataclass(frozen=True)
class Input:
    """A value that the caller of a flow gives by name."""

    name: str


@dataclass(eq=False)
class Step:
    name: str
    call: Callable[..., Any]
    state: State = State.NOT_STARTED
    output: Any = None
    callbacks: list[Callable[[Any], None]] = field(default_factory=list)

    def on_done(self, callback: Callable[[Any], None]) -> None:
        self.callbacks.append(callback)

    def value(self, of: Callable[[Any], Any] | None = None) -> Value:
        return Value(self, of)


@dataclass(frozen=True, eq=False)
class Value:
    """A step's later output, or a function of it."""

    step: Step
    of: Callable[[Any], Any] | None = None

    def get(self) -> Any:
        if self.step.state is not State.DONE:
            raise FlowError(f"step {self.step.name} has no output yet")
        return self.step.output if self.of is None else self.of(self.step.output)


class Flow:
    def __init__(self, name: str):
        self.name = name
        self.steps: list[Step] = []
        self.parents: dict[Step, set[Step]] = {}
        self.arguments: dict[Step, tuple[tuple, dict]] = {}
        self.start: Step | None = None
        self.output: Value | None = None
        self.record: dict[str, tuple[tuple, dict]] | None = None

    def add(self, name: str, call: Callable[..., Any]) -> Step:
        if any(s.name == name for s in self.steps):
            raise FlowError(f"two steps are called {name}")
        step = Step(name, call)
        self.steps.append(step)
        self.parents[step] = set()
        self.arguments[step] = ((), {})
        return step

    def start_with(self, step: Step, *args: Any, **kwargs: Any) -> None:
        if self.start is not None:
            raise FlowError("a flow has one start")
        self.start, self.arguments[step] = step, (args, kwargs)

    def connect(self, sources: Step | Iterable[Step], target: Step, *args: Any, **kwargs: Any) -> None:
        """target runs after all sources; it may take their values as arguments."""
        self.parents[target] |= {sources} if isinstance(sources, Step) else set(sources)
        if args or kwargs:
            self.arguments[target] = (args, kwargs)

    def validate(self) -> None:
        if self.start is None or self.start not in self.parents:
            raise FlowError("no start step")
        if self.parents[self.start]:
            raise FlowError("the start step has a parent")
        left, done = set(self.steps), set()
        while ready := {s for s in left if self.parents[s] <= done}:
            done |= ready
            left -= ready
        if left:
            raise FlowError("a cycle through " + ", ".join(sorted(s.name for s in left)))
        orphans = [s.name for s in self.steps if s is not self.start and not self.parents[s]]
        if orphans:
            raise FlowError("steps without a parent: " + ", ".join(orphans))
        if self.output is not None and self.output.step not in self.parents:
            raise FlowError("the output is not a step's")

    def reset(self) -> None:
        for s in self.steps:
            s.state, s.output = State.NOT_STARTED, None

    def mock(self, name: str, call: Callable[..., Any]) -> None:
        """Replaces a step's callable, for tests; with `record` set to a dict, arguments are kept there."""
        next(s for s in self.steps if s.name == name).call = call

    def _value(self, x: Any, inputs: dict[str, Any]) -> Any:
        if isinstance(x, Input):
            if x.name not in inputs:
                raise FlowError(f"input {x.name} is not given")
            return inputs[x.name]
        if isinstance(x, Step):
            return x.value().get()
        return x.get() if isinstance(x, Value) else x

    def _run(self, step: Step, inputs: dict[str, Any]) -> None:
        step.state = State.RUNNING
        try:
            args, kwargs = self.arguments[step]
            args = tuple(self._value(a, inputs) for a in args)
            kwargs = {k: self._value(a, inputs) for k, a in kwargs.items()}
            if self.record is not None:
                self.record[step.name] = (args, kwargs)
            out = step.call(*args, **kwargs)
            for f in step.callbacks:
                f(out)
            step.output, step.state = out, State.DONE
        except BaseException:
            step.state = State.FAILED
            raise

    def run(self, **inputs: Any) -> Any:
        """Runs each step once its parents are done; the first failure is raised, and nothing new starts."""
        self.validate()
        self.reset()
        waiting = [s for s in self.steps]
        with ThreadPoolExecutor(max_workers=max(1, len(self.steps))) as pool:
            running: dict[Future, Step] = {}
            done: set[Step] = set()
            while waiting or running:
                for s in [s for s in waiting if self.parents[s] <= done]:
                    waiting.remove(s)
                    running[pool.submit(self._run, s, inputs)] = s
                ended, _ = wait(running, return_when=FIRST_COMPLETED)
                for f in ended:
                    done.add(running.pop(f))
                    f.result()
        return None if self.output is None else self.output.get()


def operate(flow: Flow, data: Iterable[Any], name: str = "ip_data", **inputs: Any) -> Iterator[Any]:
    """A flow for each item, one after the other."""
    for x in data:
        yield flow.run(**{name: x}, **inputs)


def operate_in_parallel(make_flow: Callable[[], Flow], data: Iterable[Any], workers: int, name: str = "ip_data", **inputs: Any) -> Iterator[Any]:
    """Flows for many items at once, each worker with its own flow; results in the order of the items.

    At most five items a worker are taken ahead; the first failure ends all.
    """
    own = threading.local()

    def one(x: Any) -> Any:
        if not hasattr(own, "flow"):
            own.flow = make_flow()
        return own.flow.run(**{name: x}, **inputs)

    with ThreadPoolExecutor(max_workers=workers) as pool:
        ahead: list[Future] = []
        try:
            for x in data:
                ahead.append(pool.submit(one, x))
                if len(ahead) >= 5 * workers:
                    yield ahead.pop(0).result()
            while ahead:
                yield ahead.pop(0).result()
        finally:
            for f in ahead:
                f.cancel()


def retried(call: Callable[..., Any], tries: int = 5, wait_s: float = 1.0, on: tuple[type[BaseException], ...] = (Exception,)) -> Callable[..., Any]:
    """Calls again after a failure, a number of times."""

    def again(*args: Any, **kwargs: Any) -> Any:
        for k in range(tries):
            try:
                return call(*args, **kwargs)
            except on:
                if k + 1 == tries:
                    raise
                time.sleep(wait_s)

    return again


def checked_size(payload: bytes, most: int = 1 << 20) -> bytes:
    if len(payload) > most:
        raise FlowError(f"a payload of {len(payload)} bytes is above the {most} allowed")
    return payload


def batches(items: list[Any], size: int) -> list[list[Any]]:
    return [items[k : k + size] for k in range(0, len(items), size)]
