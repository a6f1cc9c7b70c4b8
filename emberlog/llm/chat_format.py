"""Conversations as a prefix forest: shared first turns are emitted once, depth first.

Every turn becomes a segment ``<s>role[INST]text[/INST]</s>`` with control strings inside roles and texts escaped
reversibly. Turns are hashed first, and only those that are emitted are tokenised. Conversations are sorted by the chain of their turns' prefix hashes; in that order, a conversation repeats
exactly the segments it shares with the one before it, so it emits only those after them. That is the depth-first
order of the prefix tree, without ever gathering a tree: sorting is by ranges, and ranges that cut a hot tree only need
the last chain of the range before. Each emitted segment carries its token ids, its place in the stream of its range,
position ids (tokens of its ancestors, then counting), and the intervals of its ancestors, which with itself are all
that it may attend to. The loss mask is the interval of an assistant's text.

Defined results: null texts and roles are empty; turns are sorted by (turn, role, text), nulls first; repeated turns
count each; a null conv_id is one conversation; an empty table gives empty tables; other columns are not read. The
driver holds one chain of hashes per range, and tasks stream conversations turn by turn.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, spool

OPEN, TEXT, END, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (OPEN, TEXT, END, CLOSE)
_special = re.compile("|".join(re.escape(x) for x in CONTROLS))
_segment = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END + CLOSE), re.S)


def escape(text: str) -> str:
    """Doubles backslashes and breaks every control string with one after its first character."""
    return _special.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(role: str, text: str) -> tuple[str, str, str]:
    """Header, content and footer of a turn."""
    return OPEN + escape(role) + TEXT, escape(text), END + CLOSE


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(unescape(a), unescape(b)) for a, b in _segment.findall(formatted)]


class Codec:
    """Turns to ids and back, many at a time."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.ids = lru_cache(maxsize=1024)(self.encoding.encode_to_numpy)  # of headers and footers, which are few

    def encode(self, roles: list[str], texts: list[str]) -> tuple[pa.ListArray, np.ndarray, np.ndarray]:
        """Ids of each turn's segment, and where its text starts and ends in them."""
        parts, starts, ends, at, stops = [], [], [], 0, [0]
        for role, text in zip(roles, texts):
            head, body, foot = render(role, text)
            a, b, c = self.ids(head), self.encoding.encode_to_numpy(body), self.ids(foot)
            parts += (a, b, c)
            starts.append(len(a))
            ends.append(len(a) + len(b))
            at += len(a) + len(b) + len(c)
            stops.append(at)
        flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(flat)), np.array(starts, np.int32), np.array(ends, np.int32)

    def decode(self, ids: pa.ListArray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The bytes of all ids, where each id starts in them, and where each row does in the ids."""
        flat = ids.flatten().to_numpy()
        return self.encoding.decode_bytes(flat.tolist()), np.concatenate([[0], np.cumsum(self.sizes[flat])]), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


TURNS = pa.schema([("conv_id", pa.int64()), ("k", pa.int64()), ("node", pa.binary()), ("role", pa.string()), ("text", pa.string())])
TURN_FIELDS = "conv_id long, k long, node binary, role string, text string"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn: adds the hash of the prefix that ends with each turn."""
    conv, k, prefix = object(), 0, b""
    for batch in batches:
        ks, nodes = [], []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if c != conv:
                conv, k, prefix = c, 0, b""
            prefix = hashlib.blake2b(prefix + f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            ks.append(k)
            nodes.append(prefix)
            k += 1
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ks, pa.int64()), pa.array(nodes, pa.binary()), batch.column("role"), batch.column("text")], schema=TURNS)


EMITTED = pa.schema([("node", pa.binary()), ("range", pa.int32()), ("rank", pa.int64()), ("depth", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss_from", pa.int32()), ("loss_to", pa.int32())])


def _tokenised(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 23):
            roles = part.column("role").to_pylist()
            ids, a, b = codec(path).encode(roles, part.column("text").to_pylist())
            said = np.array([r == "assistant" for r in roles], bool)
            yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("node", "range", "rank", "depth")), ids, pa.array(np.where(said, a, 0).astype(np.int32)), pa.array(np.where(said, b, 0).astype(np.int32))], schema=EMITTED)

    return run


PLACED = pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("rank", pa.int64()), ("own_from", pa.int64())])


FIRSTS = pa.schema([("node", pa.binary()), ("range", pa.int32()), ("first", pa.int64()), ("tokens", pa.int32())])
SPANS = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("first", pa.int64()), ("positions_from", pa.int64()), ("ancestors", pa.list_(pa.struct([("range", pa.int32()), ("from", pa.int64()), ("to", pa.int64())])))])
SPAN_FIELDS = "node binary, parent binary, first long, positions_from long, ancestors array<struct<range:int,`from`:long,to:long>>"


def _common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the common prefix: equal hashes of prefixes mean equal prefixes, so halving works."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid - 1] == b[mid - 1] else (low, mid - 1)
    return low


def prefix_forest(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``nodes``, the emitted stream, and ``paths``, which nodes a conversation consists of.

    nodes: node, parent, depth, range, first (place in the range's stream), ids, positions_from (position id of the
    first token; the others count on), ancestors (array of struct<range, from, to>: the intervals of earlier tokens that
    may be attended to, outermost first, neighbours merged), loss_from, loss_to. paths: conv_id, k, node.
    """
    segments, spans, paths = forest(turns, conv_col, turn_col, role_col, text_col, tokenizer)
    return segments.join(spans, "node"), paths


def forest(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokenizer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``nodes`` in two tables that share ``node``, segments (node, range, depth, ids, loss_from, loss_to) and spans (the rest), and ``paths``."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), empty).alias("role"), F.coalesce(F.col(text_col).cast("string"), empty).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    chained = spool(rows.mapInArrow(_chain, TURN_FIELDS))
    convs = chained.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "node"))), lambda x: x["node"]).alias("chain"))
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = spool(convs.repartitionByRange(n, "chain", "conv_id").sortWithinPartitions("chain", "conv_id").select("*", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("rank")))
    # the last chain of each range, one row per range, for the range that follows
    ends = {r["range"]: [bytes(x) for x in r["chain"]] for r in ordered.groupBy("range").agg(F.max_by("chain", "rank").alias("chain")).collect()}
    before, last = {}, []
    for r in sorted(ends):
        before[r], last = last, ends[r]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prior = None, []
        for batch in batches:
            made: dict[str, list] = {x: [] for x in PLACED.names}
            for c, chain, r, rank in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "chain", "range", "rank"))):
                if r != at:
                    at, prior = r, before[r]
                for x, v in zip(PLACED.names, (c, r, rank, _common(prior, chain))):
                    made[x].append(v)
                prior = chain
            yield pa.RecordBatch.from_pydict(made, schema=PLACED)

    placed = ordered.repartition("range").sortWithinPartitions("range", "rank").mapInArrow(place, "conv_id long, range int, rank long, own_from long")
    same = chained["conv_id"].eqNullSafe(placed["conv_id"])
    emitted = chained.join(placed, same & (chained["k"] >= placed["own_from"])).select(chained["node"], "range", "rank", chained["k"].alias("depth"), "role", "text")
    own = spool(emitted.mapInArrow(_tokenised(path), "node binary, range int, rank long, depth long, ids array<int>, loss_from int, loss_to int"))
    # place in the range's stream: a running sum by (rank, depth) inside a range
    sizes = own.select("node", "range", "rank", "depth", F.size("ids").alias("tokens"))

    def in_order(batches: Iterator[pa.RecordBatch]):
        """Rows of each range in stream order, with the place of their first token."""
        at, total = None, 0
        for batch in batches:
            made = []
            for node, r, depth, t in zip(*(batch.column(x).to_pylist() for x in ("node", "range", "depth", "tokens"))):
                at, total = (at, total) if r == at else (r, 0)
                made.append((node, r, depth, t, total))
                total += t
            yield made

    def offsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_order(batches):
            yield pa.RecordBatch.from_pylist([{"node": n, "range": r, "first": f, "tokens": t} for n, r, _, t, f in rows], schema=FIRSTS)

    streams = sizes.repartition("range").sortWithinPartitions("range", "rank", "depth").select("node", "range", "depth", "tokens")
    # where the ancestors lie that a range has in earlier ranges: those of one chain per range
    wanted = turns.sparkSession.createDataFrame([(x,) for x in {x for chain in before.values() for x in chain}], "up binary")
    known = streams.mapInArrow(offsets, "node binary, range int, first long, tokens int").join(wanted, F.col("node") == F.col("up"), "left_semi")
    seeds = {bytes(x["node"]): (x["range"], x["first"], x["first"] + x["tokens"]) for x in known.collect()}

    def extended(above: tuple, span: tuple[int, int, int]) -> tuple:
        """Intervals with one more, merged where it goes on from the last."""
        if above and above[-1][0] == span[0] and above[-1][2] == span[1]:
            return (*above[:-1], (span[0], above[-1][1], span[2]))
        return (*above, span)

    def attention(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stack = None, []  # an entry for each node on the path: its hash, the intervals down to it, their tokens
        for rows in in_order(batches):
            made: dict[str, list] = {x: [] for x in SPANS.names}
            for node, r, depth, t, first in rows:
                if r != at:
                    at, stack = r, [(None, (), 0)]
                    for x in before[r]:
                        _, above, n = stack[-1]
                        a = seeds[x]
                        stack.append((x, extended(above, a), n + a[2] - a[1]))
                del stack[depth + 1 :]
                up, above, n = stack[-1]
                stack.append((node, extended(above, (r, first, first + t)), n + t))
                ancestors = [dict(zip(("range", "from", "to"), x)) for x in above]
                for name, v in zip(SPANS.names, (node, up, first, n, ancestors)):
                    made[name].append(v)
            yield pa.RecordBatch.from_pydict(made, schema=SPANS)

    return own.drop("rank"), streams.mapInArrow(attention, SPAN_FIELDS), chained.select("conv_id", "k", "node")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Digests of every conversation, decoded from the nodes (or segments) on its path."""
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = object(), None

        def result() -> tuple:
            n, turns, chars, loss, formatted = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(dict(zip(DIGEST.names, zip(*rows))) if rows else {x: [] for x in DIGEST.names}, schema=DIGEST)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part, done = batch.slice(at, 1024), []
                data, byte_at, id_at = codec(path).decode(part.column("ids"))
                losses = zip(part.column("loss_from").to_pylist(), part.column("loss_to").to_pylist())
                for i, (c, (a, b)) in enumerate(zip(part.column("conv_id").to_pylist(), losses)):
                    if c != conv or state is None:
                        if state is not None:
                            done.append(result())
                        conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    first = id_at[i]
                    segment = data[byte_at[first] : byte_at[id_at[i + 1]]].decode()
                    for role, text in parse(segment):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    if b > a:
                        text = unescape(data[byte_at[first + a] : byte_at[first + b]].decode())
                        state[2] += len(text)
                        state[3].update(text.encode())
                    state[4] += len(segment)
                yield batch_of(done)
        if state is not None:
            yield batch_of([result()])

    rows = paths.join(nodes.select("node", "ids", "loss_from", "loss_to"), "node").select("conv_id", "k", "ids", "loss_from", "loss_to")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
