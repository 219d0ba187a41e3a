"""Handlers that take part in planning: rewrites of a plan, and decisions about a part of it.

Handlers run in the order of registration, the caller's own before the built-in ones.  A rewrite gets
what the one before returned (all of them run); of deciders the first that returns something wins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

Rewrite = Callable[[DataFrame], DataFrame | None]
Decider = Callable[[DataFrame], Any]


@dataclass
class Handlers:
    rewrites: list[Rewrite] = field(default_factory=list)
    deciders: dict[str, list[Decider]] = field(default_factory=dict)
    defaults: dict[str, list[Decider]] = field(default_factory=dict)

    def rewrite(self, handler: Rewrite) -> Rewrite:
        self.rewrites.append(handler)
        return handler

    def decide(self, what: str, handler: Decider, built_in: bool = False) -> Decider:
        (self.defaults if built_in else self.deciders).setdefault(what, []).append(handler)
        return handler

    def apply(self, df: DataFrame, keep_columns: bool = True) -> DataFrame:
        """df after all rewrites; None leaves it as it is.  With keep_columns a rewrite that changes the
        names or types of the columns is an error."""
        for handler in self.rewrites:
            after = handler(df)
            if after is None:
                continue
            if keep_columns and [(f.name, f.dataType) for f in after.schema] != [(f.name, f.dataType) for f in df.schema]:
                raise ValueError(f"{getattr(handler, '__name__', handler)} changed the columns of the plan")
            df = after
        return df

    def first(self, what: str, df: DataFrame) -> Any:
        """What the first handler that has an answer says, None if none has."""
        for handler in [*self.deciders.get(what, []), *self.defaults.get(what, [])]:
            answer = handler(df)
            if answer is not None:
                return answer
        return None
