"""The live poll as a stream: the newest posts of each forum as state, comments that join it.

Two stateful steps.  The first one, keyed by forum, sees posts only and keeps the newest N
of them; it tells which posts come in and which go out.  The second one, keyed by post,
sees these changes and the comments: a comment goes through while its post is in, waits
while the post is unknown, and is dropped when the post is out (newer posts never leave
room for older ones again).  So a busy forum's comments are dealt out by post, the first
state holds N rows a forum, and timers clear what nobody asks for any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

THREAD = "subreddit string, post_id bigint, turn bigint, type string, body string, created_date timestamp, score bigint"
CHANGE = "subreddit string, post_id bigint, state string, body string, created_date timestamp, score bigint"
LIVE = "subreddit string, post_id bigint, turn bigint, type string, state string, body string, created_date timestamp, score bigint"
KEEP_MS = 2 * 24 * 3600 * 1000  # how long comments wait for their post, and how long a post that went out is remembered
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestPosts(StatefulProcessor):
    """Per forum: the newest posts, ordered by time, then id; emits posts that come in ("in") and go out ("out")."""

    def __init__(self, limits: dict[str, int]):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "post_id bigint", "created bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        limit = self.limits.get(key[0], 0)
        kept = {post[0]: value[0] for post, value in self.kept.iterator()} if self.kept.exists() else {}
        arrived: dict[int, object] = {}
        order = dict(kept)
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.post_id not in order:
                    arrived[row.post_id], order[row.post_id] = row, row.created_date.value
            best = sorted(order, key=lambda post: (order[post], post), reverse=True)[:limit]
            order = {post: order[post] for post in best}
            arrived = {post: row for post, row in arrived.items() if post in order}
        changes = [(key[0], post, "in", row.body, row.created_date, row.score) for post, row in arrived.items()]
        for post, row in arrived.items():
            self.kept.updateValue((post,), (order[post],))
        for post in kept:
            if post not in order:
                self.kept.removeKey((post,))
                changes.append((key[0], post, "out", None, None, None))
        if changes:
            yield pd.DataFrame(changes, columns=[field.split()[0] for field in CHANGE.split(", ")])

    def close(self) -> None:
        pass


class CommentsOfPosts(StatefulProcessor):
    """Per post: whether it is in, and the comments that wait for it."""

    def __init__(self, min_score: int, keep_ms: int):
        self.min_score, self.keep_ms = min_score, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "state string")
        self.waiting = handle.getListState("waiting", "turn bigint, body string, created bigint, score bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.get()[0] if self.state.exists() else None
        found, comments = [], []
        for batch in rows:
            for row in batch.itertuples(index=False):
                if row.type == "comment":
                    if row.score >= self.min_score:
                        comments.append((int(row.turn), row.body, int(row.created_date.value), int(row.score)))
                else:
                    # A post that comes in and goes out within one batch is out.
                    state = "out" if row.state == "out" or state == "out" else "in"
                    created = row.created_date if row.state == "in" else pd.NaT
                    found.append((key[0], key[1], 0, "submission", row.state, row.body, created, row.score))
        if state is not None:
            self.state.update((state,))
        if state == "in":
            if self.waiting.exists():
                comments = [tuple(row) for row in self.waiting.get()] + comments
                self.waiting.clear()
            found += [(key[0], key[1], turn, "comment", "in", body, pd.Timestamp(created), score) for turn, body, created, score in comments]
        elif state is None and comments:
            if not self.waiting.exists():
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
            self.waiting.appendList(comments)
        elif state == "out":
            self.waiting.clear()
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        if found:
            yield pd.DataFrame(found, columns=[field.split()[0] for field in LIVE.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Comments whose post never came, and posts that are out, are forgotten."""
        self.waiting.clear()
        if self.state.exists() and self.state.get()[0] == "out":
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def read_threads(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Landed thread rows (JSON lines) as a stream."""
    return spark.readStream.schema(THREAD).option("maxFilesPerTrigger", files_per_batch).json(folder)


def live_threads(threads: DataFrame, limits: dict[str, int], min_score: int = 0, keep_ms: int = KEEP_MS) -> DataFrame:
    """Changes of the newest threads: posts that come in or go out, comments of posts that are in.

    ``threads`` is a stream of thread rows with the columns of ``THREAD``; rows of other
    forums are left out.  ``current_threads`` folds the changes into the table of now.
    """
    rows = threads.where(F.col("subreddit").isin(list(limits)))
    posts = rows.where("type = 'submission'").select("subreddit", "post_id", "body", "created_date", "score")
    changes = posts.groupBy("subreddit").transformWithStateInPandas(NewestPosts(limits), CHANGE, "Append", "None")
    nothing = F.lit(None)
    sent = changes.select("subreddit", "post_id", nothing.cast("bigint").alias("turn"), F.lit("submission").alias("type"), "state", "body", "created_date", "score")
    comments = rows.where("type = 'comment'").select("subreddit", "post_id", "turn", "type", nothing.cast("string").alias("state"), "body", "created_date", "score")
    both = sent.unionByName(comments)
    return both.groupBy("subreddit", "post_id").transformWithStateInPandas(CommentsOfPosts(min_score, keep_ms), LIVE, "Append", "ProcessingTime")


def start(live: DataFrame, output: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append the changes as parquet: of what has landed, in one batch, or ``every`` so often ("30 seconds") until stopped.

    Timers run on the clock, so a query that only stops when nothing is left to do would never stop.
    """
    live.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    writer = live.writeStream.outputMode("append").format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(once=True)).start()


def current_threads(changes: DataFrame) -> DataFrame:
    """The newest posts and their comments as of now: rows of posts that came in and did not go out."""
    gone = F.max(F.col("state") == "out").over(Window.partitionBy("subreddit", "post_id"))
    return changes.withColumn("_gone", gone).where(~F.col("_gone")).drop("_gone", "state")
