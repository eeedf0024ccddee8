"""The trie of conversations' common starts, with totals of its subtrees by time-forward processing.

A node is a distinct sequence of first turns, named by a hash of it. Subtree totals go from the deepest nodes up: nodes are
sorted in reverse level order, each takes from a priority queue what its children have sent it, and sends its own total to
its parent's place in the queue. The queue adds up what goes to one parent and spills sorted runs when it gets large.

Nodes of more than `heavy` conversations are the trie's top. Each other node whose parent is in the top is the root of a shard,
a subtree that has at most `heavy` conversations, so however many share a first turn, no task gets them all. Shards are processed apart; what
their roots send is added up for each node of the top, which is then processed in the same way. With heavy near the root of the number of
conversations both a shard and the top stay small: the top has at most one node for each `heavy` turns.
"""

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrimlake.llm.common import Scratch, no_clash, words

ROOT = hashlib.blake2b(digest_size=16).digest()
_IDS = 4096


class SpillingQueue:
    """Sums by key, taken in ascending order of keys. Keys beyond `most` go to sorted runs in unnamed files of the task, which end with it."""

    def __init__(self, most: int = 100_000):
        self.most, self.sums, self.order, self.runs = most, {}, [], []

    def add(self, key: tuple, leaves: int, saved: int) -> None:
        if key in self.sums:
            held = self.sums[key]
            self.sums[key] = (held[0] + leaves, held[1] + saved)
            return
        if len(self.sums) >= self.most:
            self._spill()
        self.sums[key] = (leaves, saved)
        heapq.heappush(self.order, key)

    def _spill(self) -> None:
        run = tempfile.TemporaryFile()
        for key in sorted(self.order):
            pickle.dump((key, *self.sums[key]), run)
        run.seek(0)
        self.sums, self.order = {}, []
        self._next(run, len(self.runs))

    def _next(self, run, tie: int) -> None:
        try:
            heapq.heappush(self.runs, (*pickle.load(run), tie, run))
        except EOFError:
            run.close()

    def take(self, key: tuple) -> tuple[int, int]:
        """The sum of what was added for the key; (0, 0) if nothing was."""
        leaves, saved = self.sums.pop(key, (0, 0))
        if self.order and self.order[0] == key:
            heapq.heappop(self.order)
        while self.runs and self.runs[0][0] == key:
            _, more, most, tie, run = heapq.heappop(self.runs)
            leaves, saved = leaves + more, saved + most
            self._next(run, tie)
        return leaves, saved


def rebuilt(turns: DataFrame, group: int = 20, starts: int = 4) -> DataFrame:
    """(conv_id, part, place, turn_key, n_words) of the turns that a conversation starts with and of its own ones, and
    a row of part -1 for the conversation itself. turns: conv_id, turn, role, text."""
    said = turns.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1
    key = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(" "), "role", "text")))
    own = said.select("conv_id", place.alias("place"), key.alias("turn_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return own.withColumn("start", F.crc32(F.col("conv_id").cast("string")) % starts).withColumn("of", F.col("conv_id") - F.col("conv_id") % group)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn's node and conversation: conversations come whole and in order, a running hash names the node."""
    now, state, depth, name = None, None, 0, ROOT
    for batch in batches:
        convs, depths, keys, parents = [], [], [], []
        for conv, part, turn_key in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "turn_key")]):
            if part < 0:
                now, state, depth, name = conv, hashlib.blake2b(digest_size=16), 0, ROOT
                parent = None
            else:
                state.update(turn_key)
                parent, name, depth = name, state.digest(), depth + 1
            convs.append(now)
            depths.append(depth)
            keys.append(name)
            parents.append(parent)
        yield pa.RecordBatch.from_arrays([pa.array(convs, pa.int64()), pa.array(depths, pa.int64()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()), batch.column("n_words")], names=["conv_id", "depth", "key", "parent", "n_words"])


def paths(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, key, parent, n_words, last) of every conversation and every node on its path."""
    own = scratch.save(rebuilt(turns), "turns")
    convs = own.groupBy("conv_id").agg(F.first("start").alias("start"), F.first("of").alias("of"))
    first = own.where("place < 3").select(F.col("conv_id").alias("of"), "place", "turn_key", "n_words")
    given = convs.join(first, "of").where("place < start").select("conv_id", F.lit(0).alias("part"), "place", "turn_key", "n_words")
    after = own.where("place >= start").select("conv_id", F.lit(1).alias("part"), "place", "turn_key", "n_words")
    head = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_key"), F.lit(0).cast("long").alias("n_words"))
    rows = head.unionByName(given).unionByName(after).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")
    return rows.mapInArrow(_paths, "conv_id long, depth long, key binary, parent binary, n_words long")


def _totals(most: int) -> Callable:
    """Time-forward processing of sorted shards. sent: what came to a node from other shards. A shard root's total goes out with the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, queue = None, SpillingQueue(most)
        for batch in batches:
            leaves, saved = [], []
            for of, depth, key, parent, own, sent, kept, childless in zip(*[batch.column(c).to_pylist() for c in ("shard", "depth", "key", "parent", "own", "sent_leaves", "sent_saved", "childless")]):
                if of != shard:
                    shard, queue = of, SpillingQueue(most)
                more, most_saved = queue.take((-depth, key))
                leaves.append(more + sent + childless)
                saved.append(most_saved + kept + own)
                if key != of and parent is not None:
                    queue.add((1 - depth, parent), leaves[-1], saved[-1])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(leaves, pa.int64()), pa.array(saved, pa.int64())], names=["key", "n_leaves", "saved_tokens"])

    return run


def subtree_totals(nodes: DataFrame, shards: DataFrame, scratch: Scratch, most: int = 100_000) -> DataFrame:
    """(key, n_leaves, saved_tokens). nodes: key, parent, depth, conv_id, own, n_children; shards: conv_id, shard: the first node of its path below the top, for top nodes null."""
    columns = ("shard", "depth", "key", "parent", "own", "sent_leaves", "sent_saved", "childless")
    ready = nodes.withColumn("childless", F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"))
    light = ready.where("not top").join(shards, "conv_id").withColumn("sent_leaves", F.lit(0).cast("long")).withColumn("sent_saved", F.lit(0).cast("long"))
    light = light.select(*columns).repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key")
    within = scratch.save(light.mapInArrow(_totals(most), "key binary, n_leaves long, saved_tokens long"), "within")
    sent = within.join(shards.select(F.col("shard").alias("key")).distinct(), "key", "left_semi").join(nodes.select("key", "parent"), "key")
    sent = sent.groupBy(F.col("parent").alias("key")).agg(F.sum("n_leaves").alias("sent_leaves"), F.sum("saved_tokens").alias("sent_saved"))
    top = ready.where("top").join(sent, "key", "left").withColumn("shard", F.lit(b"top")).fillna(0, ["sent_leaves", "sent_saved"])
    top = top.select(*columns).repartition(1).sortWithinPartitions(F.desc("depth"), "key")
    return within.unionByName(top.mapInArrow(_totals(most), "key binary, n_leaves long, saved_tokens long"))


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, joined by commas."""
    now, ids = None, []

    def given() -> tuple:
        return now, ids[0], ",".join(map(str, ids))

    for batch in batches:
        out = []
        for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (key != now or len(ids) == _IDS):
                out.append(given())
                ids = []
            now = key
            ids.append(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "ids"])
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(given(), (pa.binary(), pa.int64(), pa.string()))], names=["key", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    for batch in batches:
        out = []
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != now:
                if state:
                    out.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["key", "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of (key, conv_id): ids are joined in ranges first, so that a node at which very many
    conversations end reaches the task that digests it as a few long strings, one after the other."""
    chunks = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_joined_ids, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_digests, "key binary, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", heavy: int | None = None, most: int = 100_000) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node.

    Conversations are rebuilt first (see rebuilt()). heavy: from how many conversations on a node belongs to the top, by default
    the root of their number, 1000 at least. Rows without a conversation id are left out. A null role or text is empty; turns of
    one number are ordered by role and text, null turns come first, repeated rows are turns of their own. An empty table gives no rows. Extra columns are ignored.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    named = no_clash(turns, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text").withColumn("conv_id", F.col("conv_id").cast("long"))
    steps = scratch.save(paths(named, scratch), "steps")
    lasts = scratch.save(steps.groupBy("conv_id").agg(F.max_by("key", "depth").alias("key")), "lasts")
    heavy = heavy or max(1000, int(lasts.count() ** 0.5))
    nodes = steps.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("parent").alias("parent"), F.min("n_words").alias("n_words"))
    nodes = scratch.save(nodes, "plain")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "key", "left").fillna(0, ["n_children"]).withColumn("own", (F.col("n_convs") - 1) * F.col("n_words")).withColumn("top", (F.col("n_convs") > heavy) | (F.col("depth") == 0))
    nodes = scratch.save(nodes, "nodes")
    tops = nodes.where("top").select("key")
    below = steps.join(tops, "key", "left_semi").groupBy("conv_id").agg((F.max("depth") + 1).alias("depth"))
    shards = scratch.save(steps.join(below, ["conv_id", "depth"]).select("conv_id", F.col("key").alias("shard")), "shards")
    totals = scratch.save(subtree_totals(nodes, shards, scratch, most), "totals")
    digests = scratch.save(end_digests(lasts.select("key", "conv_id")), "digests")
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "key").join(digests, "key", "left").join(parents, "parent", "left")
    scratch.drop("turns", "steps", "lasts", "plain", "shards", "within")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
