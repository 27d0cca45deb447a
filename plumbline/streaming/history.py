"""Undo and redo as a fold over a log of commands, in batch and as a stream with state.

Commands: save(state) pushes the state before it and clears redo; undo and redo move between the stacks; cancel takes back a save that came directly
before it, redo stack and all. Each stack keeps the newest LIMIT entries.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 50  # fixed value
VERSION = 1  # of a record
_STACKS = "now bigint, undo array<bigint>, redo array<bigint>, held array<bigint>, fresh boolean, n bigint"
EMPTY: tuple = (0, (), (), (), False, 0)


def states(commands: DataFrame, kept: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """(key, now, undo, redo, held, fresh, n): each document's whole state after all its commands, in the order of (ts, seq), from its state in kept on, if it has one there, else from none.

    commands: key, ts, seq, command, state; kept: as the result. Rows are sorted by document and read one after the other, with the state alone in hand. Keys are not null. A document
    that is only in kept stays as it is.
    """
    kind = commands.schema[key].dataType.simpleString()
    log = commands.select(key, F.lit(1).alias("later"), "ts", "seq", "command", F.col("state").cast("bigint").alias("state"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in _STACKS.split(", "))])
    if kept is not None:
        none = {f.name: F.lit(None).cast(f.dataType) for f in log.schema.fields}
        old = kept.select(key, F.lit(0).alias("later"), *[none[c].alias(c) for c in ("ts", "seq", "command", "state")], "now", "undo", "redo", "held", "fresh", "n")
        log = log.unionByName(old)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, s, seen = None, EMPTY, False
        row = lambda: {key: at, **dict(zip(("now", "undo", "redo", "held", "fresh", "n"), (s[0], list(s[1]), list(s[2]), list(s[3]), s[4], s[5])))}
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                k = getattr(r, key)
                if not seen or k != at:
                    if seen:
                        out.append(row())
                    at, s, seen = k, EMPTY, True
                if r.later:
                    s = apply(s, r.command, int(r.state) if r.state == r.state and r.state is not None else 0)
                else:
                    s = (int(r.now), *(tuple(int(x) for x in stack) for stack in (r.undo, r.redo, r.held)), bool(r.fresh), int(r.n))
            if out:
                yield pd.DataFrame(out)
        if seen:
            yield pd.DataFrame([row()])

    # the flag puts what was kept before all commands
    return log.repartition(key).sortWithinPartitions(key, "later", "ts", "seq").mapInPandas(run, f"{key} {kind}, {_STACKS}")


def fold(commands: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, now, undo, redo, n): the state after all commands of each document, the stacks by their sizes."""
    return states(commands, key=key).select(key, "now", F.size("undo").cast("bigint").alias("undo"), F.size("redo").cast("bigint").alias("redo"), "n")


def records(state: DataFrame, key: str = "doc_id") -> DataFrame:
    """state as records to be written when a document is put aside: both stacks, what a cancel could bring back, and the pool of snapshots that they refer to, with the record's version."""
    return state.select(key, F.lit(VERSION).alias("version"), "now", "undo", "redo", "held", "fresh", "n", F.sort_array(F.array_distinct(F.concat(F.array("now"), "undo", "redo", "held"))).alias("pool"))


def adopted(record: DataFrame, key: str = "doc_id") -> DataFrame:
    """The states of records that can be read: of this version and with an undo stack; a stack that is missing is empty, and stacks keep their newest LIMIT entries. Others begin anew."""
    none = F.array().cast("array<bigint>")
    newest = lambda c: F.slice(c, F.greatest(F.size(c) - LIMIT + 1, F.lit(1)), F.lit(LIMIT))
    stack = lambda c: newest(F.coalesce(F.col(c), none)).alias(c)
    good = record.filter((F.col("version") == VERSION) & F.col("undo").isNotNull())
    return good.select(key, F.coalesce("now", F.lit(0)).cast("bigint").alias("now"), stack("undo"), stack("redo"), stack("held"), F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def exported(state: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, undo, redo, pool): what is saved with a project; what a cancel could bring back isn't."""
    return state.select(key, "undo", "redo", F.sort_array(F.array_distinct(F.concat("undo", "redo"))).alias("pool"))


def cleared(state: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """state with empty stacks for the documents of gone (key): a new image, or a fresh start. What is shown stays."""
    none = F.array().cast("array<bigint>")
    one = state.join(gone.select(key).distinct().withColumn("_g", F.lit(True)), key, "left")
    empty = lambda c: F.when(F.col("_g"), none).otherwise(F.col(c)).alias(c)
    return one.select(key, "now", empty("undo"), empty("redo"), empty("held"), (F.col("fresh") & F.col("_g").isNull()).alias("fresh"), "n")


def apply(state: tuple, command: str, value: int) -> tuple:
    """One command on (now, undo, redo, held, fresh, n), with tuples as stacks."""
    now, undo, redo, held, fresh, n = state
    if command == "save":
        return value, (*undo, now)[-LIMIT:], (), redo, True, n + 1
    if command == "undo" and undo:
        now, undo, redo = undo[-1], undo[:-1], (*redo, now)[-LIMIT:]
    elif command == "redo" and redo:
        now, undo, redo = redo[-1], (*undo, now)[-LIMIT:], redo[:-1]
    elif command == "cancel" and fresh:
        now, undo, redo = undo[-1], undo[:-1], held
    return now, undo, redo, (), False, n + 1


def stream(commands: DataFrame, key: str = "doc_id") -> DataFrame:
    """The same, on a stream: each batch's documents with their state so far (update mode). Commands of a batch are applied in the order of (ts, seq)."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, undo, redo, held, fresh, n = state.get if state.exists else (0, [], [], [], False, 0)
        s = (now, tuple(undo), tuple(redo), tuple(held), fresh, n)
        for row in pd.concat(list(frames)).sort_values(["ts", "seq"]).itertuples():
            s = apply(s, row.command, int(row.state))
        state.update((int(s[0]), list(map(int, s[1])), list(map(int, s[2])), list(map(int, s[3])), bool(s[4]), int(s[5])))
        yield pd.DataFrame({key: [k[0]], "now": [s[0]], "undo": [len(s[1])], "redo": [len(s[2])], "n": [s[5]]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return commands.groupBy(key).applyInPandasWithState(
        run, f"{key} bigint, now bigint, undo bigint, redo bigint, n bigint", "now bigint, undo array<bigint>, redo array<bigint>, held array<bigint>, fresh boolean, n bigint", "update", GroupStateTimeout.NoTimeout
    )
