"""Schema steps of stored tables, up and down, each a commit of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lexweave.sources.store import Change, Store, Version, together

#: What a step makes of a table, by its name; None drops it.  A table that is new gets None to begin with.
Steps = dict[str, Callable[[DataFrame | None], DataFrame | None]]


class Broken(ValueError):
    """A step whose tables would break a constraint."""


@dataclass(frozen=True)
class Migration:
    """From schema number - 1 to number, and back."""

    number: int
    up: Steps
    down: Steps = field(default_factory=dict)
    #: Rows that break a rule of the schema that up leads to; there must be none.
    broken: Callable[[dict[str, DataFrame]], DataFrame] | None = None


def migrate(store: Store, migrations: list[Migration], to: int | None = None) -> Version:
    """Goes step by step to schema number `to` (the last by default); a step is committed whole or not at all, once whoever else tries it.

    Tables that a step changes are written anew; if a writer adds rows to one of them meanwhile, the step is made anew.
    """
    by_number = {m.number: m for m in migrations}
    if sorted(by_number) != list(range(1, len(migrations) + 1)):
        raise ValueError("migrations are numbered from 1 without a gap")
    goal = len(migrations) if to is None else to
    if not 0 <= goal <= len(migrations):
        raise ValueError(f"there is no schema {goal}")
    while True:
        now = store.latest().schema
        if now == goal:
            return store.latest()
        step = by_number[now + 1] if now < goal else by_number[now]
        after = now + 1 if now < goal else now - 1
        rules = step.broken if now < goal else by_number[after].broken if after else None

        def build(version: Version) -> Change | None:
            if version.schema != now:
                return None
            parts, tables = [Change(schema=after)], {t: store.read(t, version) for t in version.columns}
            for name, make in (step.up if now < goal else step.down).items():
                tables[name] = make(tables.get(name))
                old = version.folders.get(name, [])
                parts.append(Change(forget=(name,), drop={name: old}) if tables[name] is None else together(store.stage(name, tables[name]), drop={name: old}))
            if rules is not None:
                wrong = rules({t: rows for t, rows in tables.items() if rows is not None}).limit(5).collect()
                if wrong:
                    raise Broken(f"schema {after}: {[tuple(r) for r in wrong]}")
            return together(*parts)

        store.transact(build)
