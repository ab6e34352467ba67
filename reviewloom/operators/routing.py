"""Prompts dealt to several providers, each within its rate, with a fall back to the next.

A provider's rate is shared evenly by a fixed number of tasks, each of which
holds a token bucket for it: over any span of s seconds all tasks together
make at most ``tasks * burst + per_second * s`` calls.  A task that is run
again after a lost executor asks again for its own prompts, so calls are made
at least once; write the replies before they are read twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.staging import fresh_name


@dataclass(frozen=True)
class Provider:
    """A named service; ``make`` gives its client once per task, ``tries`` are made for a prompt before the next provider is asked."""

    name: str
    make: Callable[[], Callable[[str], str]]
    per_second: float
    burst: int = 1
    tries: int = 4
    pause: float = 0.0  # seconds before the second try, twice that before the third, and so on


class Bucket:
    """Tokens that come at ``rate`` a second, up to ``burst``; taking one waits until there is one."""

    def __init__(self, rate: float, burst: int, clock: Callable[[], float], sleep: Callable[[float], None]):
        if rate <= 0 or burst < 1:
            raise ValueError("a rate above 0 and a burst of at least 1 are needed")
        self.rate, self.burst, self.clock, self.sleep = rate, burst, clock, sleep
        self.tokens, self.at = float(burst), clock()

    def _fill(self) -> None:
        now = self.clock()
        self.tokens, self.at = min(float(self.burst), self.tokens + (now - self.at) * self.rate), now

    def take(self) -> None:
        self._fill()
        while self.tokens < 1 - 1e-9:
            self.sleep((1 - self.tokens) / self.rate)
            self._fill()
        self.tokens -= 1


class Router:
    """What one task knows of its providers: their clients, made when first asked, and their buckets."""

    def __init__(self, providers: list[Provider], tasks: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.providers, self.sleep = {p.name: p for p in providers}, sleep
        self.buckets = {p.name: Bucket(p.per_second / tasks, p.burst, clock, sleep) for p in providers}
        self.clients: dict[str, Callable[[str], str]] = {}

    def order(self, first: str | None) -> list[str]:
        return sorted(self.providers, key=lambda name: name != first)  # a stable sort: the others as they were given

    def ask(self, prompt: str | None, first: str | None = None) -> tuple[str | None, str | None, int, str | None]:
        """(provider that answered, reply, calls made, last error where none answered)."""
        calls, error = 0, "no prompt"
        for name in self.order(first) if prompt is not None else []:
            provider = self.providers[name]
            for k in range(provider.tries):
                if k and provider.pause:
                    self.sleep(k * provider.pause)
                self.buckets[name].take()
                calls += 1
                try:
                    if name not in self.clients:
                        self.clients[name] = provider.make()
                    return name, self.clients[name](prompt), calls, None
                except Exception as e:  # noqa: BLE001  what a service throws is its own affair
                    error = f"{name}: {type(e).__name__}: {e}"
        return None, None, calls, error


def route(prompts: DataFrame, providers: list[Provider], key: str = "custom_id", first: str | None = None, tasks: int = 8) -> DataFrame:
    """(key, provider, text, calls, error) for each prompt, a null one included.

    ``first`` is a column that names the provider a prompt prefers; with a null
    or an unknown name, and for those it falls back to, they come as given.
    """
    if not providers or len({p.name for p in providers}) < len(providers):
        raise ValueError("providers need names of their own")
    kind = dict(prompts.dtypes)[key]
    sent = prompts.select(F.col(key).alias("k"), F.col("prompt").alias("p"), (F.col(first) if first else F.lit(None)).cast("string").alias("f"))
    salt = fresh_name(sent, "salt")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        router = Router(providers, tasks)
        for part in parts:
            got = [router.ask(None if pd.isna(p) else p, None if pd.isna(f) else f) for p, f in zip(part["p"], part["f"])]
            yield pd.DataFrame({"k": part["k"].to_numpy(), **{c: pd.Series([g[i] for g in got], dtype=t) for i, (c, t) in enumerate([("provider", object), ("text", object), ("calls", "int64"), ("error", object)])}})

    # Dealt by key and text: equal keys with different prompts, such as null ones, don't meet in one task.
    dealt = sent.withColumn(salt, F.xxhash64("k", "p")).repartition(tasks, salt).drop(salt)
    return dealt.mapInPandas(run, f"k {kind}, provider string, text string, calls long, error string").withColumnRenamed("k", key)
