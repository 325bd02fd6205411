"""Structured Streaming forms of ingestion, loop verdicts and cache expiry."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.dedup import SHORTEST, THRESHOLD, fuzzy_deduplicated
from corvane.operators.markup import cleaned, flattened, parsed
from corvane.operators.store import pages_to_ingest
from corvane.sources.shared import file_system, written


#: The target of page ingestion is partitioned by a digest of doc_id, so a micro-batch reads the keys of its own parts.
BUCKETS = 256


def ingest_pages(stream: DataFrame, target: str, checkpoint: str, done: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Pages (doc_id, page_num, markup) to sentence rows under `target`, each page once.

    A batch that is replayed finds its pages stored and writes nothing; `done` is told of each batch.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int"))
        files, at = file_system(spark, f"{target}/_SUCCESS")
        if files.exists(at):
            touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
            keys = pages_to_ingest(batch.select("doc_id", "page_num"), spark.read.parquet(target).filter(F.col("bucket").isin(touched)))
            batch = batch.join(keys, ["doc_id", "page_num"], "left_semi")
        rows = cleaned(flattened(parsed(batch.drop("bucket"))))
        rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int")).write.mode("append").partitionBy("bucket").parquet(target)
        if done:
            done(rows, number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_texts(rows: DataFrame, order: list[str], shortest: int = SHORTEST) -> DataFrame:
    """Of a stream of rows (doc_id, text, ...) those whose text is the first of its document, in every micro-batch so
    far; texts under `shortest`, and null ones, all. The state of a document is the digests of its texts; within a
    micro-batch the first in order (a total one) counts."""
    short = F.coalesce(F.length("text") < shortest, F.lit(True))
    schema = rows.schema

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        found = pd.concat(list(batches)).sort_values(order).drop_duplicates("__text")
        found = found[~found["__text"].isin(seen)]
        if len(found):
            state.update(([*seen, *found["__text"]],))
            yield found[schema.names]

    own = rows.withColumn("__text", F.md5("text"))
    firsts = own.filter(~short).groupBy("doc_id").applyInPandasWithState(step, schema, "seen array<string>", "append", GroupStateTimeout.NoTimeout)
    return firsts.unionByName(rows.filter(short))


def ingest_deduplicated(rows: DataFrame, target: str, checkpoint: str, order: list[str], threshold: float = THRESHOLD, shortest: int = SHORTEST) -> StreamingQuery:
    """A stream of sentence rows (id, doc_id, page_num, text, and order) to `target`, without repeated texts: exact ones
    of a document, whenever they come, and fuzzy ones of a page, whose rows must come in one micro-batch.

    Pages must come in reading order from one micro-batch to the next for the first text to be the one that stays. A
    replayed micro-batch replaces its own table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        cut = lambda df: written(spark, df, "stream-dedup")
        kept = fuzzy_deduplicated(batch, ["doc_id", "page_num"], order, cut, threshold, shortest, fits=True)
        kept.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return first_texts(rows, order, shortest).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


VERDICT = "session_id long, seq long, rule string, verdict string"
STATE = "tools array<string>, args array<string>, results array<string>, fail_tools array<string>, fail_counts array<int>, fired int, last_seq long"


class _Calls:
    """The last few calls of a session, and the failures of each tool in the run that lasts."""

    def __init__(self, held: tuple | None, repeats: int, cycles: int, failures: int):
        self.tools, self.args, self.results, names, counts, self.fired, self.seq = (list(x) if hasattr(x, "__iter__") and not isinstance(x, str) else x for x in held) if held else ([], [], [], [], [], 0, None)
        self.fails = dict(zip(names, counts, strict=True))
        self.repeats, self.cycles, self.failures, self.keep = repeats, cycles, failures, max(repeats, 2 * cycles)

    def judged(self, r) -> tuple:
        """seq, rule, verdict of the next call."""
        repeats, cycles, keep = self.repeats, self.cycles, self.keep
        self.seq, tool = int(r.seq), r.tool.lower()
        self.tools, self.args, self.results = [*self.tools, tool][-keep:], [*self.args, r.args_hash][-keep:], [*self.results, r.result_hash][-keep:]
        self.fails = {} if r.success else {**self.fails, r.tool: self.fails.get(r.tool, 0) + 1}
        same = repeats > 0 and len(self.tools) >= repeats and len(set(zip(self.tools[-repeats:], self.args[-repeats:], self.results[-repeats:], strict=True))) == 1
        last = self.tools[-2 * cycles :]
        pong = cycles >= 2 and len(last) == 2 * cycles and len(set(last)) == 2 and len(set(last[::2])) == 1 and len(set(last[1::2])) == 1
        streak = any(n >= self.failures for n in self.fails.values())
        rule = "no_progress" if same else "ping_pong" if pong else "failure_streak" if streak else None
        self.fired += rule is not None
        return self.seq, rule, "CONTINUE" if rule is None else "INJECT_WARNING" if self.fired == 1 else "HARD_STOP"

    def state(self) -> tuple:
        return self.tools, self.args, self.results, [*self.fails], [*self.fails.values()], self.fired, self.seq


def loop_verdicts(calls: DataFrame, repeats: int = 3, cycles: int = 2, failures: int = 3) -> DataFrame:
    """The verdict on every call, from the last few calls and the failures of each tool in the run that lasts.

    Calls of a session must come in order from one micro-batch to the next, as a log's files do; within one
    they are sorted. A call with a smaller seq than the last one judged is an error, not a wrong verdict;
    ordered_verdicts() waits for late ones.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own, out = _Calls(state.get if state.exists else None, repeats, cycles, failures), []
        for r in pd.concat([*batches]).sort_values("seq").itertuples():
            if own.seq is not None and int(r.seq) < own.seq:
                raise ValueError(f"session {key[0]}: call {r.seq} comes after call {own.seq}")
            out.append((key[0], *own.judged(r)))
        state.update(own.state())
        yield pd.DataFrame(out, columns=["session_id", "seq", "rule", "verdict"])

    return calls.groupBy("session_id").applyInPandasWithState(step, VERDICT, STATE, "append", GroupStateTimeout.NoTimeout)


HELD = ["seq", "ms", "tool", "args_hash", "result_hash", "success"]
_Call = namedtuple("_Call", HELD)
WAITING = STATE + ", " + ", ".join(f"held_{c} array<{t}>" for c, t in zip(HELD, ("long", "long", "string", "string", "string", "boolean"), strict=True))


def ordered_verdicts(calls: DataFrame, late: str = "1 hour", repeats: int = 3, cycles: int = 2, failures: int = 3) -> DataFrame:
    """As loop_verdicts() for calls (also ts, an event time that grows with seq) that may come late: a session's calls
    wait in its state until the watermark, `late` behind the newest call of all, has passed them, and are then judged in
    order. A call that comes later still is dropped by the watermark; calls newer than it have no verdict yet."""

    n = len(STATE.split(", "))

    # plain lists: a session has a few calls a micro-batch, for which frames would cost more than the calls
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        own = _Calls(held[:n] if held else None, repeats, cycles, failures)
        waiting = [_Call(*x) for x in zip(*held[n:], strict=True)] if held else []
        if not state.hasTimedOut:
            for new in batches:
                ms = new["ts"].to_numpy().astype("datetime64[ns]").astype("int64") // 1_000_000
                waiting += map(_Call, new["seq"].tolist(), ms.tolist(), *(new[c].tolist() for c in HELD[2:]))
        waiting.sort(key=lambda x: x.seq)
        passed = state.getCurrentWatermarkMs()
        out = [own.judged(x) for x in waiting if x.ms < passed]
        waiting = [x for x in waiting if x.ms >= passed]
        state.update((*own.state(), *([x[c] for x in waiting] for c in range(len(HELD)))))
        if waiting:
            state.setTimeoutTimestamp(min(x.ms for x in waiting) + 1)
        if out:
            seq, rule, verdict = zip(*out, strict=True)
            yield pd.DataFrame({"session_id": [key[0]] * len(out), "seq": seq, "rule": rule, "verdict": verdict})

    return calls.withWatermark("ts", late).groupBy("session_id").applyInPandasWithState(step, VERDICT, WAITING, "append", GroupStateTimeout.EventTimeTimeout)


ENTRY = "key string, newest timestamp, writes long"


def expired_entries(entries: DataFrame, seconds: int = 3600, late: str = "0 seconds") -> DataFrame:
    """From a stream of cache writes (key, ts) the entries whose time to live is over: key, newest write, writes.

    The state of a key is its live entry, a session of writes. It goes, and is put out, once the watermark is beyond
    the time to live; a write after that begins a new entry. Times count in milliseconds.
    """
    # half a millisecond more: a write at the very end of the time to live still renews, and the end itself isn't beyond it
    live = F.session_window("ts", f"{1_000_000 * seconds + 500} microseconds")
    own = entries.withColumn("ts", F.date_trunc("millisecond", "ts")).withWatermark("ts", late)
    return own.groupBy("key", live).agg(F.max("ts").alias("newest"), F.count(F.lit(1)).alias("writes")).select("key", "newest", "writes")


def file_stream(spark: SparkSession, schema, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
