"""Exchanges of messages between groups of documents and buckets of keys.

A group sends a bucket one message, and a bucket answers a group with one. Sent as
they are, that makes a row for each pair of the two, and both grow with the input.
So only up to FAN buckets are addressed directly. Beyond, messages take two hops:
a group sends one row to each *range* of buckets; the rows of a *clan* of groups
meet there and leave as one row for each bucket of the range; answers go the same
way back. With ranges and clans of about the square root of the number of buckets,
10**7 buckets take a few thousand rows a group.

A row holds lists of equal length, a message each. What senders and receivers see
are flat tables, a message a row, whatever way it came.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textlattice.llm.common import power_of_two

#: Buckets that every group addresses directly.
FAN = 256


def packed(t: pa.Table, by: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The distinct values of by, ascending, and for each the list of its rows in every column."""
    order = np.argsort(by, kind="stable")
    by, t = by[order], t.take(pa.array(order))
    cut = np.flatnonzero(np.concatenate(([True], by[1:] != by[:-1]))) if len(by) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(cut, len(by)), pa.int32())
    return by[cut], {c: pa.ListArray.from_arrays(offsets, t[c].combine_chunks()) for c in t.column_names}


def flat(t: pa.Table, columns: list[str]) -> dict[str, pa.Array]:
    """The messages of all rows, column by column; a row without a list in a column adds nothing there."""
    out = {}
    for c in columns:
        parts = [y for x in t[c].chunks if x.null_count < len(x) and len(y := x.flatten())]
        out[c] = pa.concat_arrays(parts) if parts else pa.array([], t.schema.field(c).type.value_type)
    return out


class Exchange:
    def __init__(self, n_groups: int, n_buckets: int):
        self.n_buckets = n_buckets
        self.direct = n_buckets <= FAN
        #: Buckets of a range, and groups of a clan.
        self.fold = 1 if self.direct else power_of_two(int(n_buckets**0.5))
        self.clan = n_groups if self.direct else self.fold

    @staticmethod
    def schema(columns: list[str]) -> str:
        return "at int, clan int, bucket array<int>, g array<int>, " + ", ".join(f"{c} array<binary>" for c in columns)

    @staticmethod
    def told(columns: list[str]) -> str:
        return "g int, " + ", ".join(f"{c} array<binary>" for c in columns)

    def sends(self, f: Callable, columns: list[str], hears: list[str] = ()) -> Callable:
        """For applyInArrow on groups: f gets the documents (and what the group was told, by column) and returns (bucket, g, columns)."""

        def run(docs: pa.Table) -> pa.Table:
            return self._rows(f(docs), columns)

        def run_told(docs: pa.Table, told: pa.Table) -> pa.Table:
            return self._rows(f(docs, flat(told, hears)), columns)

        return run_told if hears else run

    def _rows(self, t: pa.Table, columns: list[str]) -> pa.Table:
        at, lists = packed(t.select(["bucket", "g", *columns]), t["bucket"].to_numpy() // self.fold)
        clan = t["g"][0].as_py() // self.clan if len(t) else 0
        return pa.table({"at": pa.array(at, pa.int32()), "clan": pa.array([clan] * len(at), pa.int32()), **lists})

    def answers(self, sent: DataFrame, f: Callable, columns: list[str], back: list[str]) -> DataFrame:
        """f gets all messages of a bucket (bucket, g, columns) and returns (g, back); the result has a row with lists for each group, or several."""
        fold, clan, direct = self.fold, self.clan, self.direct

        def gather(t: pa.Table) -> pa.Table:
            """Messages of a clan to a range of buckets, bucket by bucket."""
            own = pa.table(flat(t, ["bucket", "g", *columns]))
            at, lists = packed(own, own["bucket"].to_numpy())
            return pa.table({"at": pa.array(at, pa.int32()), "clan": pa.array([t["clan"][0].as_py()] * len(at), pa.int32()), **lists})

        def answer(t: pa.Table) -> pa.Table:
            own = pa.table(flat(t, ["bucket", "g", *columns]))
            out = f(own).select(["g", *back])
            g = out["g"].to_numpy()
            to, lists = packed(out, g if direct else g // clan)
            if direct:
                return pa.table({"g": pa.array(to, pa.int32()), **{c: lists[c] for c in back}})
            return pa.table({"clan": pa.array(to, pa.int32()), "at": pa.array([own["bucket"][0].as_py() // fold] * len(to), pa.int32()), **lists})

        def split(t: pa.Table) -> pa.Table:
            """Answers of a range of buckets to a clan, group by group."""
            own = pa.table(flat(t, ["g", *back]))
            to, lists = packed(own, own["g"].to_numpy())
            return pa.table({"g": pa.array(to, pa.int32()), **{c: lists[c] for c in back}})

        if direct:
            return sent.groupBy("at").applyInArrow(answer, self.told(back))
        sent = sent.groupBy("at", "clan").applyInArrow(gather, self.schema(columns))
        lists = ", ".join(f"{c} array<binary>" for c in back)
        answered = sent.groupBy("at").applyInArrow(answer, f"clan int, at int, g array<int>, {lists}")
        return answered.groupBy("clan", "at").applyInArrow(split, self.told(back))
