"""Routing over providers: rates in a test clock, fall back, recorded failures."""

from __future__ import annotations

import random
import sys

import pytest
from pyspark import cloudpickle

from reviewloom.operators.routing import Bucket, Provider, Router, route

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import the tests


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, s):
        assert s >= 0
        self.now += s


def failing():
    def reply(prompt):
        raise RuntimeError("down")

    return reply


@pytest.mark.parametrize(("rate", "burst"), [(2.0, 1), (0.5, 3), (7.0, 10)])
def test_bucket_holds_its_rate_over_every_span(rate, burst):
    clock, draw, calls = Clock(), random.Random(3), []
    b = Bucket(rate, burst, clock, clock.sleep)
    for _ in range(200):
        clock.now += draw.choice([0, 0, 0, 0.1, 5])
        b.take()
        calls.append(clock.now)
    for i, a in enumerate(calls):
        for j in range(i, len(calls)):
            assert j - i + 1 <= burst + rate * (calls[j] - a) + 1e-6
    assert calls[-1] > 0


def test_bucket_refuses_what_never_gives_a_token():
    with pytest.raises(ValueError):
        Bucket(0, 1, Clock(), lambda s: None)
    with pytest.raises(ValueError):
        Bucket(1, 0, Clock(), lambda s: None)


def test_failures_move_on_and_each_try_takes_a_token():
    clock = Clock()
    router = Router([Provider("a", failing, 4.0, tries=3, pause=1.0), Provider("b", lambda: str.upper, 4.0)], 2, clock, clock.sleep)
    assert router.ask("x") == ("b", "X", 4, None)
    assert clock.now == pytest.approx(3.0)  # pauses of one and two seconds, in which the tokens come
    assert router.ask("y", "b") == ("b", "Y", 1, None)
    assert router.ask("z", "unknown")[:3] == ("b", "Z", 4)
    assert router.ask(None) == (None, None, 0, "no prompt")


def test_client_that_cannot_be_made_is_a_failure():
    def broken():
        raise OSError("no route")

    clock = Clock()
    router = Router([Provider("a", broken, 100.0, tries=2)], 1, clock, clock.sleep)
    assert router.ask("x") == (None, None, 2, "a: OSError: no route")


def test_route_answers_every_row(spark):
    def odd():
        def reply(prompt):
            if len(prompt) % 2 == 0:
                raise ValueError("even")
            return "odd"

        return reply

    rows = [(k, "x" * k if k else "", ["a", "b", None, "c"][k % 4]) for k in range(40)] + [(7, None, "a"), (7, "x" * 7, "b"), (None, "xy", "b")]
    df = spark.createDataFrame(rows, "custom_id long, prompt string, to string")
    got = route(df, [Provider("a", odd, 1e6, 99, tries=2), Provider("b", lambda: len_text, 1e6, 99)], first="to", tasks=3).collect()
    want = []
    for k, p, to in rows:
        if p is None:
            want.append((k, None, None, 0, "no prompt"))
        elif to == "b":
            want.append((k, "b", str(len(p)), 1, None))
        else:
            want.append((k, "a", "odd", 1, None) if len(p) % 2 else (k, "b", str(len(p)), 3, None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def len_text(prompt):
    return str(len(prompt))


def test_no_provider_answers_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "x")], "custom_id long, prompt string")
    assert tuple(route(df, [Provider("a", failing, 1e6, 9, tries=2)]).first()) == (1, None, None, 2, "a: RuntimeError: down")
    assert route(df.limit(0), [Provider("a", failing, 1.0)]).count() == 0
    with pytest.raises(ValueError):
        route(df, [Provider("a", failing, 1.0), Provider("a", failing, 1.0)])
