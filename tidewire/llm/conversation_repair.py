"""Conversation structure repair: the cheapest edits that make a conversation alternate, by a time-major tensor program.

Turns may be kept, given another role, deleted or inserted, so that the roles' initials read ``(s?(ua)+)?``. Four states
(nothing yet, after s, after u, after a) and the turn's features decide what an edit costs and where it leads. Conversations of a
bucket are grouped by length, padded to a power of two, and their costs to the end are brought back turn by turn for all of
them at once, as one array of (turn, conversation, state). Edits are then traced forward, again for all at once; where several
are cheapest, the one of least initial is taken (D, I, K, R), which leads to the least audit, since an edit's initial
settles the next state. A conversation longer than ``SPAN`` is cut into spans: each span's costs between all pairs of
states are found side by side, combined from the end by (min, +), and its edits traced from each state it may begin in.

Rows are dealt by buckets of conversations; a bucket's features (some 40 bytes a turn) come before its texts, which then stream
through one digest a conversation. So a task holds the features of one bucket and no texts. One conversation is never split over
tasks, as its digest and audit are one sequence.

Cases: a null conv_id is a conversation; null turns come first and aren't counted as gaps; a null role or text is one
space; rows of equal turn go by role, then text (by 64 characters and two 64-bit hashes); a repeated row is a duplicate;
a conversation without turns has no edits; an empty table has no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import arrow_schema, bound_batches, table, tidy

SPAN = 256
#: A bucket has about so many turns (more only where one conversation has more).
BUCKET_ROWS = 1 << 13
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
_FAR = 1 << 50
#: States: nothing yet, after s, after u, after a; and where the next user or assistant leads.
_NEXT = np.array([2, 2, 3, 2])
_ROLE = {2: "user", 3: "assistant"}
_WHITE = " \t\n\x0b\x0c\r"
_PAD, _D, _K, _R = 0, ord("D"), ord("K"), ord("R")
_REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_TURNS = "position bigint, edit string, role string, text string"


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with one of five faults by crc32 of ``conv_id:turn``; ``gone`` marks those that are dropped."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    hurt = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), hurt.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _closed(costs: np.ndarray) -> np.ndarray:
    """Costs by state when turns may be inserted first."""
    for _ in range(3):
        costs = np.minimum(costs, INSERT + costs[..., _NEXT])
    return costs


class Turns:
    """Features by (time, conversation): ``who`` (0 s, 1 u, 2 a, 3 other), ``drop`` (must go), ``cut`` and ``pad``."""

    def __init__(self, who: np.ndarray, drop: np.ndarray, cut: np.ndarray, pad: np.ndarray):
        self.who, self.drop, self.cut, self.pad = who, drop, cut, pad

    def tiled(self, k: int) -> Turns:
        return Turns(*(np.tile(x, (1, k)) for x in (self.who, self.drop, self.cut, self.pad)))

    def edits(self, t: int, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Costs of D, K and R by state, when ``after`` are those that follow, and where K leads."""
        who, own = self.who[t][:, None], np.where(self.drop[t], _FAR, CUT_OFF * self.cut[t])[:, None]
        onward = after[:, _NEXT]
        state = np.arange(4)
        system = (who == 0) & (state == 0)
        fits = system | ((who == 1) & (state != 2)) | ((who == 2) & (state == 2))
        keep = np.where(fits, KEEP + own + np.where(system, after[:, 1:2], onward), _FAR)
        return DELETE + after, keep, REROLE + own + onward, np.where(system, 1, _NEXT)

    def costs(self, end: np.ndarray) -> np.ndarray:
        """Least costs from each turn to ``end`` (conversation, state)."""
        out = np.empty((len(self.who) + 1, *end.shape), np.int64)
        out[-1] = _closed(end)
        for t in range(len(self.who) - 1, -1, -1):
            delete, keep, rerole, _ = self.edits(t, out[t + 1])
            best = np.minimum(np.minimum(delete, keep), rerole)
            out[t] = np.where(self.pad[t][:, None], out[t + 1], _closed(best))
        return np.minimum(out, _FAR)

    def trace(self, costs: np.ndarray, end: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By time: the state before it, turns inserted there, and the edit; then turns inserted at the end, and the last state."""
        times, n = self.who.shape
        before, added, edit = np.zeros((times, n), np.int8), np.zeros((times, n), np.int8), np.zeros((times, n), np.uint8)
        every, state = np.arange(n), state.copy()
        for t in range(times):
            before[t] = state
            delete, keep, rerole, leads = self.edits(t, costs[t + 1])
            left = ~self.pad[t]
            for _ in range(4):
                now = costs[t, every, state]
                d = left & (now == delete[every, state])
                i = left & ~d & (now == INSERT + costs[t, every, _NEXT[state]])
                k = left & ~d & ~i & (now == keep[every, state])
                r = left & ~d & ~i & ~k & (now == rerole[every, state])
                edit[t][d], edit[t][k], edit[t][r] = _D, _K, _R
                added[t] += i
                state = np.where(k, leads[every, state], np.where(i | r, _NEXT[state], state))
                left = i
        last = np.zeros(n, np.int8)
        for _ in range(4):
            i = costs[times, every, state] != end[every, state]
            i &= costs[times, every, state] < _FAR
            last += i
            state = np.where(i, _NEXT[state], state)
        return before, added, edit, last, state


_END = np.array([0, _FAR, _FAR, 0])


def _short(turns: Turns):
    n = turns.who.shape[1]
    end = np.broadcast_to(_END, (n, 4))
    costs = turns.costs(end)
    before, added, edit, last, _ = turns.trace(costs, end, np.zeros(n, np.int64))
    return costs[0, :, 0], before, added, edit, last


def _long(turns: Turns):
    """One conversation whose spans are the columns of ``turns``."""
    times, n = turns.who.shape
    four = turns.tiled(4)
    unit = np.repeat(np.where(np.eye(4, dtype=bool), 0, _FAR), n, axis=0)
    between = four.costs(unit)[0].reshape(4, n, 4)  # to a state, span, from a state
    ends = np.empty((n, 4), np.int64)
    ends[-1] = _END
    for i in range(n - 1, 0, -1):
        ends[i - 1] = (between[:, i] + (_closed(ends[i]) if i == n - 1 else ends[i])[:, None]).min(0)
    ends = np.minimum(ends, _FAR)
    costs = turns.costs(ends)
    tiled = np.tile(costs, (1, 4, 1))
    before, added, edit, last, leaves = (x.reshape(*x.shape[:-1], 4, n) for x in four.trace(tiled, np.tile(ends, (4, 1)), np.repeat(np.arange(4), n)))
    state, begins = 0, np.empty(n, np.int64)
    for i in range(n):
        begins[i] = state
        state = leaves[state, i]
    pick = lambda x: x[..., begins, np.arange(n)]
    return costs[0, 0, 0], pick(before), pick(added), pick(edit), pick(last)


def solve(who: np.ndarray, drop: np.ndarray, cut: np.ndarray, counts: np.ndarray, span: int = SPAN):
    """For conversations of ``counts`` turns one after the other: costs by conversation; by turn the state before it, turns inserted
    there and the edit; turns inserted at the end by conversation."""
    total, n = int(counts.sum()), len(counts)
    start = np.cumsum(counts) - counts
    cost, last = np.zeros(n, np.int64), np.zeros(n, np.int8)
    before, added, edit = np.zeros(total, np.int8), np.zeros(total, np.int8), np.zeros(total, np.uint8)

    def laid(at: np.ndarray, inside: np.ndarray) -> Turns:
        take = lambda x: np.where(inside, x[np.minimum(at, total - 1)], 0)
        return Turns(take(who), take(drop).astype(bool), take(cut).astype(bool), ~inside)

    width = np.where(counts > 0, 1 << np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64), 0)
    for w in np.unique(width[(width > 0) & (counts <= span)]).tolist():
        own = np.flatnonzero((width == w) & (counts <= span))
        # at most some 2 ** 18 cells a state at once
        for part in np.array_split(own, max(1, len(own) * w >> 18)):
            t = np.arange(w)[:, None]
            inside, at = t < counts[part], start[part] + t
            cost[part], b, a, e, last[part] = _short(laid(at, inside))
            before[at[inside]], added[at[inside]], edit[at[inside]] = b[inside], a[inside], e[inside]
    for c in np.flatnonzero(counts > span).tolist():
        spans = -(-int(counts[c]) // span)
        flat = np.arange(spans)[None, :] * span + np.arange(span)[:, None]
        inside, at = flat < counts[c], start[c] + flat
        cost[c], b, a, e, ends = _long(laid(at, inside))
        before[at[inside]], added[at[inside]], edit[at[inside]] = b[inside], a[inside], e[inside]
        last[c] = ends[-1]
    return cost, before, added, edit, last


class Bucket:
    """The conversations of one bucket: features first, then texts in the same order."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []

    def work_out(self) -> None:
        rows = pa.Table.from_batches(self.parts)
        self.parts = []
        get = lambda c: rows.column(c).combine_chunks()
        ids, gone = get("conv_id"), get("gone").to_numpy(zero_copy_only=False)
        known = np.array(ids.is_valid().to_numpy(zero_copy_only=False))
        value = ids.fill_null(0).to_numpy(zero_copy_only=False)
        new = np.append(True, (value[1:] != value[:-1]) | (known[1:] != known[:-1])) if len(value) else np.zeros(0, bool)
        conv = np.cumsum(new) - 1
        self.ids = ids.take(pa.array(np.flatnonzero(new))).to_pylist()
        here = np.flatnonzero(~gone)
        n, conv = len(self.ids), conv[here]
        take = lambda c: get(c).to_numpy(zero_copy_only=False)[here]
        who, blank, whole = take("who").astype(np.int64), take("blank").astype(bool), take("whole").astype(bool)
        order = np.lexsort((np.arange(len(here)), take("h2"), take("h1"), conv))
        a, b = take("h1")[order], take("h2")[order]
        seen = np.zeros(len(here), bool)
        seen[order[1:]] = (a[1:] == a[:-1]) & (b[1:] == b[:-1]) & (np.diff(conv[order]) == 0)
        twice = ~blank & seen
        cut = ~blank & ~twice & ~whole
        count = lambda mask: np.bincount(conv[mask], minlength=n)
        same = np.diff(conv) == 0
        legal = ((who[:-1] == 0) & (who[1:] == 1)) | ((who[:-1] == 1) & (who[1:] == 2)) | ((who[:-1] == 2) & (who[1:] == 1))
        illegal = np.bincount(conv[1:][same & ~legal], minlength=n)
        turns = get("turn")
        has = np.array(turns.is_valid().to_numpy(zero_copy_only=False))[here]
        turn, whose = turns.fill_null(0).to_numpy(zero_copy_only=False)[here][has], conv[has]
        # turns ascend in a conversation
        fresh = np.append(True, (turn[1:] != turn[:-1]) | (whose[1:] != whose[:-1]))[: len(turn)]
        distinct = np.bincount(whose[fresh], minlength=n)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, whose, turn)
        np.maximum.at(high, whose, turn)
        gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)
        self.conv, self.counts = conv, np.bincount(conv, minlength=n)
        cost, self.before, self.added, self.edit, self.last = solve(who, blank | twice, cut, self.counts)
        self.figures = [gaps, count(blank), count(twice), count(cut), illegal, cost]
        self.audits = self._audits()

    def _audits(self) -> list[str]:
        ends = np.cumsum(self.counts)
        length = self.added.astype(np.int64) + 1
        by_conv = np.add.reduceat(np.append(length, 0), ends - self.counts) * (self.counts > 0) + self.last
        stop = np.cumsum(by_conv)
        letters = np.full(int(stop[-1]) if len(stop) else 0, ord("I"), np.uint8)
        shift = np.repeat((np.cumsum(self.last.astype(np.int64)) - self.last), self.counts)
        letters[np.cumsum(length) - 1 + shift] = self.edit
        text = letters.tobytes().decode()
        return [text[b - a : b] for a, b in zip(by_conv.tolist(), stop.tolist(), strict=True)]

    def turns_of(self, row: int, role: str, text: str):
        """What row ``row`` becomes: inserted turns, then itself unless it is deleted, as (edit, role, text)."""
        state = int(self.before[row])
        for _ in range(self.added[row]):
            state = int(_NEXT[state])
            yield "I", _ROLE[state], ""
        edit = chr(self.edit[row])
        if edit != "D":
            yield edit, _ROLE[int(_NEXT[state])] if edit == "R" else role, text

    def closing(self, c: int, last_role: str):
        for _ in range(self.last[c]):
            last_role = "assistant" if last_role == "user" else "user"
            yield "I", last_role, ""


def _stream(rows: DataFrame) -> DataFrame:
    """Features and texts of each bucket, in order."""
    total = rows.count()
    bare = F.expr("rtrim('" + "".join(f"\\u{ord(c):04x}" for c in _WHITE) + "', text)")
    who = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in zip("sua", range(3), strict=True) for x in pair]), F.substring("role", 1, 1)), F.lit(3))
    bucket = F.pmod(F.xxhash64("conv_id"), F.lit(max(1, total // BUCKET_ROWS)))
    both = rows.select(bucket.alias("bucket"), "conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text", "gone", F.substring("text", 1, 64).alias("head"), F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(13), "text", "role").alias("h2"), bare.alias("bare"), who.alias("who"))
    each = F.explode(F.when(F.col("gone"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))).alias("kind")
    feature = F.col("kind") == 0
    out = both.select("*", each).select("bucket", "kind", "conv_id", "gone", "turn", "role", "head", "h1", "h2", F.when(~feature, F.col("text")).alias("text"), F.when(feature, F.col("who")).alias("who"), F.when(feature, F.col("bare") == "").alias("blank"), F.when(feature, F.substring("bare", -1, 1).isin(".", "!", "?")).alias("whole"))
    return out.repartition("bucket").sortWithinPartitions("bucket", "kind", F.col("conv_id").asc_nulls_first(), "gone", F.col("turn").asc_nulls_first(), "role", "head", "h1", "h2")


def _run(stream: DataFrame, schema: str, told):
    """``told(bucket, rows)`` turns a bucket's text rows, an iterator of (row, role, text), into rows of ``schema``."""
    out = arrow_schema(schema)
    bound_batches(stream.sparkSession)

    def flush(ready):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*ready, strict=True), out, strict=True)], schema=out)

    def pieces(batches):
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False) * 2 + batch.column(1).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for i, j in zip(bounds[:-1], bounds[1:], strict=True):
                if j > i:
                    yield int(key[i]) // 2, int(key[i]) % 2, batch.slice(i, j - i)

    def run(batches):
        ready, source = [], pieces(batches)
        ahead = next(source, None)
        while ahead:
            here, bucket = ahead[0], Bucket()
            while ahead and ahead[:2] == (here, 0):
                bucket.parts.append(ahead[2].select(["conv_id", "gone", "turn", "who", "blank", "whole", "h1", "h2"]))
                ahead = next(source, None)
            bucket.work_out()

            def texts(here=here):
                nonlocal ahead
                row = 0
                while ahead and ahead[0] == here:
                    names = ahead[2].schema.names
                    for role, text in zip(ahead[2].column(names.index("role")).to_pylist(), ahead[2].column(names.index("text")).to_pylist(), strict=True):
                        yield row, role, text
                        row += 1
                    ahead = next(source, None)

            for line in told(bucket, texts()):
                ready.append(line)
                if len(ready) >= 4096:
                    yield flush(ready)
                    ready = []
        if ready:
            yield flush(ready)

    return stream.mapInArrow(tidy(run), schema)


def _mended(bucket: Bucket, texts):
    """(conversation, edit, role, text) of all turns that stay or are added, in order."""
    conv, role = -1, "assistant"
    for row, own, text in texts:
        if bucket.conv[row] != conv:
            if conv >= 0:
                yield from ((conv, *x) for x in bucket.closing(conv, role))
            conv, role = int(bucket.conv[row]), "assistant"
        for x in bucket.turns_of(row, own, text):
            role = "user" if x[1][:1] == "u" else "assistant"
            yield conv, *x
    if conv >= 0:
        yield from ((conv, *x) for x in bucket.closing(conv, role))


def _marked(conversations: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    # the table itself may have a column of that name and another kind
    gone = F.col("gone") if "gone" in conversations.columns and dict(conversations.dtypes)["gone"] == "boolean" else F.lit(False).alias("gone")
    return conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text("role"), text("text"), gone)


def repaired(conversations: DataFrame) -> DataFrame:
    """The turns of all conversations after the cheapest edits: conv_id, position from 0, edit (K, R or I), role and text."""

    def told(bucket, texts):
        last, position = None, 0
        for conv, edit, role, text in _mended(bucket, texts):
            position = position + 1 if conv == last else 0
            last = conv
            yield bucket.ids[conv], position, edit, role, text

    return _run(_stream(_marked(conversations)), "conv_id bigint, " + _TURNS, told)


def report(conversations: DataFrame) -> DataFrame:
    """A row a conversation: its faults, the cost and initials of its cheapest edits, and the digest of what they leave.

    A boolean column ``gone`` marks rows that only say that a conversation exists.
    """

    def told(bucket, texts):
        digests: dict[int, str] = {}
        conv, digest = -1, hashlib.sha256()
        for c, _, role, text in _mended(bucket, texts):
            if c != conv:
                if conv >= 0:
                    digests[conv] = digest.hexdigest()
                conv, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if conv >= 0:
            digests[conv] = digest.hexdigest()
        none = hashlib.sha256().hexdigest()
        for c, (conv_id, audit) in enumerate(zip(bucket.ids, bucket.audits, strict=True)):
            yield conv_id, *(int(x[c]) for x in bucket.figures), audit, digests.get(c, none)

    return _run(_stream(_marked(conversations)), "conv_id bigint, " + _REPORT, told)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(damage(table(spark, sf_dir, "conversations")))
