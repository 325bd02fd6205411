"""The search cache as a service over one stream of operations, with keyed state.

Operations (at, seq, op, key, doc, docs, results, ttl) come in a stream; at is in seconds, seq makes their order total:

    put         an entry under a key, with the documents that its results name; it replaces the key's older one
    get         a hit gives the results and raises the entry's access count; an entry over its time to live is a
                miss and goes
    delete      the entry of a key
    invalidate  every entry whose results name a document
    clear       every entry
    sweep       every entry over its time to live

Keys are dealt to PARTS groups, whose state is a map of their entries; a group's operations of a micro-batch are applied in
order. invalidate, clear and sweep go to every group, so each costs PARTS rows and no search over keys elsewhere. Operations
must not come in a later micro-batch than later ones.

An operation's row in the output: seq, key, op, hit (of a get), results, access_count, and evicted, the entries that went;
those of operations for all groups come once a group, with its number.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PARTS = 16
#: Entries of a group that a task holds in memory.
HELD = 100_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "part int, seq long, op string, key string, hit boolean, results string, access_count long, evicted long"
FOR_ALL = ("invalidate", "clear", "sweep")


class Cache(StatefulProcessor):
    """The entries of a group. Those that a micro-batch touches are read from the state once, and written back at its end;
    operations on all keys hold the whole group, up to HELD entries, beyond which they go through the state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "at double, ttl double, docs array<string>, results string, hits long")
        self._begin()

    def _begin(self) -> None:
        self.held: dict[str, tuple | None] = {}
        self.changed: set[str] = set()
        self.whole = False

    def _flush(self) -> None:
        for k in self.changed:
            if (x := self.held[k]) is not None:
                self.entries.updateValue((k,), x)
            elif self.entries.containsKey((k,)):
                self.entries.removeKey((k,))
        self._begin()

    def _entry(self, key: str) -> tuple | None:
        if key not in self.held:
            if len(self.held) >= HELD and not self.whole:
                self._flush()
            found = None if self.whole or not self.entries.containsKey((key,)) else self.entries.getValue((key,))
            self.held[key] = found and tuple(found)
        return self.held[key]

    def _put(self, key: str, entry: tuple | None) -> None:
        self.held[key] = entry
        self.changed.add(key)
        if len(self.held) > 2 * HELD:
            self._flush()

    def _evicted(self, goes) -> int:
        if not self.whole:
            self._flush()
            for (k,), x in self.entries.iterator():
                if len(self.held) >= HELD:
                    self._begin()
                    break
                self.held[k] = tuple(x)
            else:
                self.whole = True
        if self.whole:
            gone = [k for k, x in self.held.items() if x is not None and goes(*x)]
            for k in gone:
                self._put(k, None)
        else:
            gone = [k for k, x in self.entries.iterator() if goes(*x)]
            for k in gone:
                self.entries.removeKey(k)
        return len(gone)

    def _applied(self, r) -> tuple:
        """hit, results, access_count, evicted of one operation."""
        if r.op == "put":
            self._put(r.key, (float(r.at), float(r.ttl), [str(d) for d in r.docs], r.results, 0))
            return None, None, 0, 0
        if r.op == "get":
            if (held := self._entry(r.key)) is None:
                return False, None, 0, 0
            at, ttl, docs, results, hits = held
            if r.at - at > ttl:
                self._put(r.key, None)
                return False, None, 0, 1
            self._put(r.key, (at, ttl, list(docs), results, hits + 1))
            return True, results, hits + 1, 0
        if r.op == "delete":
            held = self._entry(r.key)
            if held is not None:
                self._put(r.key, None)
            return None, None, None, int(held is not None)
        if r.op == "invalidate":
            return None, None, None, self._evicted(lambda at, ttl, docs, results, hits: r.doc in docs)
        if r.op == "clear":
            return None, None, None, self._evicted(lambda *_: True)
        if r.op == "sweep":
            return None, None, None, self._evicted(lambda at, ttl, *_: r.at - at > ttl)
        raise ValueError(f"no operation named {r.op}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [*rows]
        if frames:
            own = pd.concat(frames).sort_values(["at", "seq"])
            out = [(int(key[0]), int(r.seq), r.op, r.key, *self._applied(r)) for r in own.itertuples()]
            self._flush()
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ANSWER.split(", ")]).astype({"access_count": "Int64"})

    def close(self) -> None:
        pass


def answers(operations: DataFrame, parts: int = PARTS) -> DataFrame:
    """ANSWER of a stream of operations. The session's state store must keep maps (STORE)."""
    of_key = F.array(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    part = F.when(F.col("op").isin(*FOR_ALL), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(of_key)
    own = operations.select(F.explode(part).alias("part"), "at", "seq", "op", "key", "doc", "docs", "results", "ttl")
    return own.groupBy("part").transformWithStateInPandas(Cache(), ANSWER, "Append", "None")
