"""Reassembly of conversations from turns that arrive in batches, late, twice or not at all, by a stateful streaming query.

Conversations are hashed to buckets, which are the keys of the state. A bucket's state holds its conversations and a timing wheel:
PATIENCE + 1 slots of (conversation, generation), filed by the batch in which a conversation closes unless it is heard of before.
An arrival raises a conversation's generation and files it anew; its older entries stay where they are and are passed over when
their slot comes. Each batch brings a tick for each bucket, which opens the one slot that is due; the last tick closes all.
Conversations and slots are kept as bytes each, and only those that a batch touches are read.

What enters the state is a turn's number, role and the digest of its payload, never a text; turns that were released leave only
their role, and that only while a neighbour may still come. Arrivals of one turn are combined before the shuffle. A conversation
stays within one bucket, as the digest of its unreleased turns is one hash over all their numbers.

Defined cases: null turns are dropped; null roles and texts are empty; null conv_ids are one conversation; of equal payloads of
one turn in one batch the smallest role counts; repeated rows are one arrival; an empty table gives no event; further columns
don't enter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ._shared import bounded_batches, task_count, work_path

#: Batches that an input is cut into, and successive ones without arrivals that close a conversation.
BATCHES, PATIENCE = 8, 3
#: Conversations of a bucket, about.
BUCKET = 500
#: conv is the decimal conv_id, or NO_ID; a tick has no sha256.
ARRIVAL, NO_ID = "bucket int, conv string, turn long, first long, role string, sha256 string, batch int", "null"
EVENT = "event string, conv_id long, turn long, batch long, sha256 string, n_missing long, n_breaks long"
STATE = "convs array<string>, states array<binary>, slots array<binary>"


def arrivals(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(conv_id, turn, first, role, sha256, batch): what arrives in which batch, one row a turn and batch."""
    rows = conversations.where("turn is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.conv(F.substring(F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), F.lit(":"), F.col("turn").cast("string")), 256), 1, 8), 16, 10).cast("long"))
    place = lambda h: (h % batches).cast("int")
    once = F.struct(place(F.col("h")).alias("batch"), F.col("role").alias("role"))
    late = F.struct(place(F.col("h") + 3).alias("batch"), F.lit("user").alias("role"))
    rows = rows.withColumn("a", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, late)).otherwise(F.array(once))))
    rows = rows.select("conv_id", "turn", "a.batch", F.struct(F.concat("a.role", F.lit("|"), "text").alias("payload"), "a.role").alias("said"))
    kept = rows.groupBy("conv_id", "turn", "batch").agg(F.min("said").alias("said"))
    kept = kept.select("conv_id", "turn", "batch", "said.role", F.sha2("said.payload", 256).alias("sha256"))
    firsts = conversations.where("turn is not null").groupBy(F.col("conv_id").cast("long").alias("of")).agg(F.min("turn").cast("long").alias("first"))
    return kept.join(firsts, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")


def _digest(numbers: list[int]) -> str:
    import hashlib

    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def _number(conv: str) -> int | None:
    return None if conv == NO_ID else int(conv)


class Conversation:
    """first, next: the turn that is released next; turns: number to (role, digest, None once released); counts so far; generation."""

    __slots__ = ("breaks", "closed", "first", "generation", "kept", "largest", "next", "turns")

    def __init__(self, first: int):
        self.first = self.next = first
        self.turns: dict[int, tuple[str, str | None]] = {}
        self.kept, self.largest, self.breaks, self.generation, self.closed = 0, first, 0, 0, False

    def keep(self, turn: int, role: str, digest: str) -> None:
        if turn in self.turns or turn < self.next:  # all before `next` are kept
            return
        self.turns[turn] = (role, digest)
        self.kept, self.largest = self.kept + 1, max(self.largest, turn)
        self.breaks += sum(t in self.turns and self.turns[t][0] == role for t in (turn - 1, turn + 1))

    def release(self) -> Iterator[tuple[int, str]]:
        """The gapless run from `next`. Of what was released only the last role is needed, for the turn that follows it."""
        while self.next in self.turns:
            role, digest = self.turns[self.next]
            self.turns[self.next] = (role, None)
            self.turns.pop(self.next - 1, None)
            yield self.next, digest
            self.next += 1

    def unreleased(self) -> list[int]:
        return sorted(t for t, (_, digest) in self.turns.items() if digest is not None)

    def missing(self) -> int:
        return self.largest - self.first + 1 - self.kept


class Bucket:
    """The state of one bucket: its conversations by name and the slots of its wheel, each as bytes until it is needed."""

    def __init__(self, stored: tuple | None, last: int, patience: int):
        names, states, slots = stored or ([], [], [b""] * (patience + 1))
        self.last, self.patience, self.slots = last, patience, list(slots)
        self.states: dict[str, bytes] = dict(zip(names, states, strict=True))
        self.out: list[tuple] = []

    def stored(self) -> tuple:
        return list(self.states), list(self.states.values()), self.slots

    def entries(self, slot: int) -> list[tuple[str, int]]:
        return pickle.loads(self.slots[slot]) if self.slots[slot] else []  # noqa: S301  written here

    def batch(self, number: int, data: pd.DataFrame) -> None:
        filed = []
        for conv, own in data.groupby("conv"):
            filed += self.arrived(number, conv, own.sort_values("turn"))
        if filed:
            slot = (number + self.patience) % len(self.slots)
            self.slots[slot] = pickle.dumps(self.entries(slot) + filed)
        self.tick(number)

    def arrived(self, number: int, conv: str, own: pd.DataFrame) -> list[tuple[str, int]]:
        """The entry that files the conversation anew; none if it is closed."""
        conv_id, got = _number(conv), self.states.get(conv)
        state: Conversation = pickle.loads(got) if got else Conversation(int(own["first"].iloc[0]))  # noqa: S301  written here
        if state.closed:
            self.out += [("reject", conv_id, int(t), number, d, None, None) for t, d in zip(own["turn"], own["sha256"], strict=True)]
            return []
        for t, role, d in zip(own["turn"], own["role"], own["sha256"], strict=True):
            state.keep(int(t), role, d)
        self.out += [("release", conv_id, t, number, d, None, None) for t, d in state.release()]
        state.generation += 1
        self.states[conv] = pickle.dumps(state)
        return [(conv, state.generation)]

    def tick(self, number: int) -> None:
        """Closes what is due in this batch; the last tick closes all that is open."""
        if number >= self.last:
            for conv in list(self.states):
                self.ended(number, conv, None)
            return
        slot = number % len(self.slots)
        due, self.slots[slot] = self.entries(slot), b""
        for conv, generation in due:
            self.ended(number, conv, generation)

    def ended(self, number: int, conv: str, generation: int | None) -> None:
        state: Conversation = pickle.loads(self.states[conv])  # noqa: S301  written here
        if state.closed or generation is not None and generation != state.generation:
            return
        self.out.append(("close", _number(conv), -1, number, _digest(state.unreleased()), state.missing(), state.breaks))
        state.closed, state.turns = True, {}
        self.states[conv] = pickle.dumps(state)


def _taken(last: int, patience: int):
    """What a batch does to the state of a bucket, for applyInPandasWithState."""

    def run(key, rows: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows), ignore_index=True)
        bucket = Bucket(state.getOption, last, patience)
        for number in sorted(set(data["batch"])):  # one at a time, should several have been put into one run
            bucket.batch(int(number), data[(data["batch"] == number) & data["sha256"].notna()])
        state.update(bucket.stored())
        yield pd.DataFrame(bucket.out, columns=[c.split()[0] for c in EVENT.split(", ")]).astype({"conv_id": "Int64", "n_missing": "Int64", "n_breaks": "Int64"})

    return run


def reassemble(conversations: DataFrame, batches: int = BATCHES, patience: int = PATIENCE, buckets: int | None = None) -> DataFrame:
    """(event, conv_id, turn, batch, sha256, n_missing, n_breaks): releases, rejects and closes of all batches.

    The batches are files in a new folder below the shared one. For each, and for the end, the query is started anew on one
    checkpoint, takes what is new in its input folder, and ends.
    """
    spark = conversations.sparkSession
    bounded_batches(spark)
    folder = work_path(spark, "turns")
    staged = f"{folder}/staged"
    tasks = task_count(conversations)
    arrivals(conversations, batches).coalesce(tasks).write.partitionBy("batch").parquet(staged)
    rows = spark.read.schema("conv_id long, turn long, first long, role string, sha256 string, batch int").parquet(staged)
    if buckets is None:
        buckets = max(2 * spark.sparkContext.defaultParallelism, -(-rows.agg(F.approx_count_distinct("conv_id")).first()[0] // BUCKET))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("conv_id"), F.lit(buckets)).cast("int")).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(NO_ID)))
    names = [c.split()[0] for c in ARRIVAL.split(", ")]
    tick = [F.col("id").cast("int").alias("bucket"), *[F.lit(x).alias(n) for n, x in (("conv", ""), ("turn", 0), ("first", 0), ("role", ""))], F.lit(None).cast("string").alias("sha256")]
    for number in range(batches + 1):
        ticks = spark.range(0, buckets, 1, 1).select(*tick, F.lit(number).alias("batch"))
        now = rows.where(F.col("batch") == number).select(*names) if number < batches else None
        (ticks if now is None else now.coalesce(max(1, tasks // batches)).unionByName(ticks)).write.mode("append").parquet(f"{folder}/in")
        _started(spark, folder, batches, patience)
    return spark.read.schema(EVENT).parquet(f"{folder}/events")


def _started(spark: SparkSession, folder: str, batches: int, patience: int) -> None:
    """One start of the query on its checkpoint, until what is new has been taken. The state store is the session's (RocksDB where states outgrow memory)."""
    stream = spark.readStream.schema(ARRIVAL).parquet(f"{folder}/in")
    events = stream.groupBy("bucket").applyInPandasWithState(_taken(batches, patience), EVENT, STATE, "append", GroupStateTimeout.NoTimeout)
    query = events.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/events").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
