"""Jaccard self-join of documents on word n-grams by a token-group matrix.

A document is the set of its k-word shingles; equal sets are one node. Similar nodes go to one group: nodes are ordered by their smallest
shingle hashes and cut where the smallest changes or a group is full. The matrix tells for each token which groups hold it. It is stored in two
forms: exact for the tokens of prefixes, and hashed to slots (a bitmap of each member, whose union is the group's row) for
all tokens. Two sets of similarity t or more share a token among the first n - ceil(t n) + 1 of either set of n in any one order
of all tokens, so groups without a common prefix token are never paired. At a token, two groups meet by those members alone whose prefixes hold it: by
their sizes and by sketches of 128 slots, what all of one side have and none of the other has. Of a pair of groups that is left, each member counts its
slots that a member of the other group lacks: those tokens can't be shared, and only members that may still reach the threshold with some member are
opened: tokens of one group's full sets are looked up in the other's, which gives all intersections exactly.

The order of tokens puts those last which many prefixes hold (passages and lines that documents share): prefixes in hash order are counted
over all documents first, and the most frequent tokens, as many as a broadcast may hold, go to the end. Any order is exact.

Scale: a group has at most `members` sets and `tokens` tokens (one larger text is a group alone); groups, not documents, are
paired, so n near copies are n / members rows a token. Equal sets leave a task once. The shuffles carry prefixes and bitmaps, about
a third of the texts; full sets are read again only for groups of several members and for members that may have a link, told apart by a bitmap of
their ids, so that texts are never shuffled. First each group is opened for itself
and with its hub, the largest group of several that most of its tokens name. When those links are known, groups that lie wholly in one component need
no look at each other; of a token that many groups hold only the groups that aren't wholly in the component of most of them are paired with
the others; and where two groups are mostly of one component, only the members outside it are compared. So near copies by the thousand
cost about one comparison each, and no link between components is lost. Counting all links (counted) needs all pairs: that work grows with
the number of links.

Defined results: null and empty texts have an empty set and no link; a repeated row is a copy, and copies are linked; rows that share a
doc_id but not their text are nodes of their own; a row without an id is linked with nothing and has a null component; an empty table gives an
empty result; extra columns are ignored; a very long text is handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from feedspark.llm import common as C
from feedspark.llm.components import connected_components

#: A token in more prefixes than this may go to the end of the order.
FREQUENT = 3
#: Groups that share a token are paired with each other up to this number.
CROWD = 16
#: Smallest hashes by which nodes are ordered.
LOWS = 4
#: Words of 64 slots of a sketch.
WORDS = 2


def _prefix(own: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(n * percent / 100) + 1 elements of a sorted set of n, those in common last."""
    n = len(own) + (-percent * len(own) // 100) + 1
    if not len(common):
        return own[:n]
    at = np.searchsorted(common, own)
    at[at == len(common)] = 0
    last = common[at] == own
    return np.concatenate([own[~last], own[last]])[:n]


def _width(n: int) -> int:
    """Slots of the bitmap of n tokens."""
    return max(64, 1 << (2 * n - 1).bit_length())


def _bitmap(own: np.ndarray) -> bytes:
    width = _width(len(own))
    slots = np.zeros(width, bool)
    slots[(own >> np.uint64(65 - width.bit_length())).astype(np.int64)] = True
    return np.packbits(slots).tobytes()


def _sketch(own: np.ndarray) -> list[int]:
    """Slots that a set fills, by the first bits of its tokens."""
    slots = np.zeros(64 * WORDS, bool)
    slots[(own >> np.uint64(65 - slots.size.bit_length())).astype(np.int64)] = True
    return np.packbits(slots).view(np.int64).tolist()


def _print(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _frequent(k: int, percent: int):
    """Prefixes in hash order; a set that the task has seen is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        none = np.zeros(0, np.uint64)
        for _, data, offs in C.chunks(batches, "text"):
            out = []
            for own in C.shingle_sets(data, offs, k):
                if len(own) and _new(own, seen):
                    out.append(_prefix(own, percent, none))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["token"])

    return run


def _new(own: np.ndarray, seen: set[bytes]) -> bool:
    mark = _print(own)
    if mark in seen:
        return False
    if len(seen) > 200_000:
        seen.clear()
    seen.add(mark)
    return True


_OWN = "doc_id long, n_shingles long, print binary, l0 long, l1 long, l2 long, l3 long, marks binary, sketch array<long>, prefix array<long>"


def _scanned(k: int, percent: int, common):
    """A row a document; what is derived from the set only where the task meets it first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = common.value
        for part, data, offs in C.chunks(batches, "text"):
            sizes, prints, lows, marks, sketches, prefixes = [], [], [], [], [], []
            for i, own in enumerate(C.shingle_sets(data, offs, k)):
                sizes.append(len(own))
                prints.append(_print(own) if len(own) else None)
                first = len(own) and part.column("doc_id")[i].is_valid and _new(own, seen)
                lows.append([*own[:LOWS].view(np.int64).tolist(), *[0] * (LOWS - len(own))] if first else [None] * LOWS)
                marks.append(_bitmap(own) if first else None)
                sketches.append(_sketch(own) if first else None)
                prefixes.append(_prefix(own, percent, last).view(np.int64) if first else None)
            columns = [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            columns += [*(pa.array(x, pa.int64()) for x in zip(*lows, strict=True)), pa.array(marks, pa.binary())]
            columns += [pa.array(x, pa.list_(pa.int64())) for x in (sketches, prefixes)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _OWN.split(", ")])

    return run


_GROUPS = "group long, nodes array<long>, docs array<long>, prints array<binary>, sizes array<int>, marks binary, sketches array<array<long>>, prefixes array<array<long>>"


#: The array columns of groups, by node, and what one node has of them.
_ONE = {"nodes": "node", "docs": "doc_id", "prints": "print", "sizes": "size", "sketches": "sketch", "prefixes": "prefix"}


def _grouped(members: int, tokens: int):
    """Rows in the order of their smallest hashes -> groups. Equal sets are neighbours and become one node; node div members is its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        done: list[tuple] = []
        count, before, low, held_tokens, done_bytes = 0, None, None, 0, 0

        def close():
            nonlocal count, done_bytes
            own = list(zip(*held, strict=True))
            first = (base + count) * members
            done.append((base + count, list(range(first, first + len(held))), own[0], own[1], own[2], b"".join(own[3]), own[4], list(own[5])))
            count += 1
            done_bytes += 8 * sum(map(len, own[5])) + len(done[-1][5]) + (64 + 8 * WORDS) * len(held)
            held.clear()

        def flush() -> pa.RecordBatch:
            nonlocal done_bytes
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), *[pa.list_(pa.list_(pa.int64()))] * 2]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            done_bytes = 0
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _GROUPS.split(", ")])

        for batch in batches:
            rows = (batch.column(c).to_pylist() for c in ("doc_id", "n_shingles", "print", "l0", "marks", "sketch"))
            for i, (doc, size, mark, first, bits, sketch) in enumerate(zip(*rows, strict=True)):
                if mark == before:
                    continue
                if held and (first != low or len(held) == members or held_tokens + size > tokens):
                    close()
                    held_tokens = 0
                held.append((doc, mark, size, bits, sketch, batch.column("prefix")[i].values.to_numpy()))
                before, low, held_tokens = mark, first, held_tokens + size
                if done_bytes > 1 << 20:
                    yield flush()
        if held:
            close()
        if done:
            yield flush()

    return run


def _widths(sizes: np.ndarray, marks: np.ndarray) -> list[np.ndarray]:
    """The members' bitmaps, one after the other in marks."""
    ends = np.cumsum([_width(int(n)) // 8 for n in sizes])
    return [np.unpackbits(marks[e - _width(int(n)) // 8 : e]).astype(bool) for n, e in zip(sizes, ends, strict=True)]


def _at_width(m: np.ndarray, width: int) -> np.ndarray:
    """Slots that a bitmap may fill, in `width` slots."""
    return m.reshape(width, -1).any(axis=1) if len(m) >= width else np.repeat(m, width // len(m))


def _reaching(sizes: np.ndarray, maps: list[np.ndarray], others: np.ndarray, other_maps: list[np.ndarray], percent: int) -> np.ndarray:
    """Which members (rows) may be linked with which others (columns), by the slots that the other lacks."""
    out = np.zeros((len(sizes), len(others)), bool)
    widths = np.array([len(m) for m in maps])
    for width in np.unique(widths):
        fit = (widths == width)[:, None] & (100 * others >= percent * sizes[:, None]) & (100 * sizes[:, None] >= percent * others)
        rows, columns = np.flatnonzero(fit.any(axis=1)), np.flatnonzero(fit.any(axis=0))
        if len(rows):
            own, theirs = [maps[i] for i in rows], [_at_width(other_maps[j], width) for j in columns]
            if width <= 1 << 20:  # counts are exact in single precision
                met = np.stack(own).astype(np.float32) @ np.stack(theirs).astype(np.float32).T
            else:
                met = np.array([[np.count_nonzero(x & y) for y in theirs] for x in own])
            both = sizes[rows][:, None] - (np.array([np.count_nonzero(x) for x in own])[:, None] - met)
            out[np.ix_(rows, columns)] = (100 + percent) * both >= percent * (sizes[rows][:, None] + others[columns])
    return out


_PAIRS = "a long, b long, whole boolean, xs array<long>, ys array<long>"


def _qualified(percent: int, members: int):
    """The pairs of groups that have to be opened, with those nodes of each that may be linked with some of the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, (a, b, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "whole")), strict=True)):
                sizes = [batch.column(f"sizes_{s}")[i].values.to_numpy().astype(np.int64) for s in "ab"]
                maps = [_widths(n, np.frombuffer(batch.column(f"marks_{s}")[i].as_buffer(), np.uint8)) for n, s in zip(sizes, "ab", strict=True)]
                near = _reaching(sizes[0], maps[0], sizes[1], maps[1], percent)
                if near.any():
                    near &= _reaching(sizes[1], maps[1], sizes[0], maps[0], percent).T
                if near.any():
                    rows.append((a, b, whole, a * members + np.flatnonzero(near.any(axis=1)), b * members + np.flatnonzero(near.any(axis=0))))
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], ["a", "b", "whole", "xs", "ys"])

    return run


def _sets(k: int, wanted):
    """Full sets of the rows whose slot is in a bitmap; a repeated row is needed once."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = wanted.value
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            yield batch.filter(pa.array(cells[slots >> 6] >> (slots & 63).astype(np.uint64) & np.uint64(1) == 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for part, data, offs in C.chunks(some(batches), "text"):
            rows = []
            for doc, own in zip(part.column("doc_id").to_pylist(), C.shingle_sets(data, offs, k), strict=True):
                mark = _print(own)
                if len(own) and (doc, mark) not in seen:
                    seen.add((doc, mark))
                    rows.append((doc, mark, own.tobytes()))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "set"])

    return run


class Opened:
    """A group's full sets, as one list of tokens in order with their owners."""

    def __init__(self, members: pa.StructArray):
        self.nodes, self.copies, self.comps = (members.field(c).to_numpy() for c in ("node", "copies", "comp"))
        self.sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in members.field("set")]
        self.sizes = np.array([len(x) for x in self.sets])
        owner = np.repeat(np.arange(len(self.sets)), self.sizes)
        tokens = np.concatenate(self.sets)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many tokens each member shares with a set."""
        left, right = np.searchsorted(self.tokens, own, "left"), np.searchsorted(self.tokens, own, "right")
        n = right - left
        at = np.repeat(left - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.sets))


class _Roots:
    """Components of the members of two groups, as they are joined."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def __call__(self, v: int) -> int:
        while self.parent.setdefault(v, v) != v:
            self.parent[v] = v = self.parent[self.parent[v]]  # from left to right
        return v

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self(a), self(b)
        self.parent[a] = b
        return a != b


def _links_of(x: Opened, y: Opened | None, percent: int, counted: bool) -> list[tuple]:
    """Links (a, b, null) between components that join them, and if counted (node, null, documents linked). y: None for x itself, whose
    nodes come each with the smallest one of their component instead."""
    same, roots, rows = y is None, _Roots(), []
    y = y or x
    linked = np.zeros(len(y.nodes), np.int64)
    targets = y.comps.tolist()
    for q, own in enumerate(x.sets):
        mine = int(x.comps[q])
        if not counted and all(roots(t) == roots(mine) for t in targets):
            continue
        both = y.shared(own)
        near = 100 * both >= percent * (len(own) + y.sizes - both)
        if same:
            near[q] = False
        hits = np.flatnonzero(near)
        if counted and len(hits):
            rows.append((int(x.nodes[q]), None, int(y.copies[hits].sum())))
            linked[hits] += x.copies[q]
        joined = [(mine, targets[h], None) for h in hits if roots.join(mine, targets[h])]
        rows += [] if same else joined
    if counted and not same:
        rows += [(int(y.nodes[h]), None, int(linked[h])) for h in np.flatnonzero(linked)]
    return rows + _stars(roots, targets) if same else rows


def _stars(roots: _Roots, nodes: list[int]) -> list[tuple]:
    """(node, smallest node, null) of components of several nodes."""
    parts: dict[int, list[int]] = {}
    for v in nodes:
        parts.setdefault(roots(v), []).append(v)
    return [(v, min(own), None) for own in parts.values() if len(own) > 1 for v in own]


def _settled(percent: int, counted: bool):
    """Components within groups: rows (members), whose comp is the node itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for own in batch.column("members"):
                rows += _links_of(Opened(own.values), None, percent, counted)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["a", "b", "links"])

    return run


def _joined(percent: int, counted: bool):
    """_links_of all rows (members_a, members_b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for x, y in zip(batch.column("members_a"), batch.column("members_b"), strict=True):
                if len(x.values):
                    rows += _links_of(Opened(x.values), Opened(y.values), percent, counted)
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], ["a", "b", "links"])

    return run


class Join:
    """The steps of the join over one table of documents."""

    def __init__(self, docs: DataFrame, k: int, percent: int, members: int, tokens: int, counted: bool):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.k, self.percent, self.members, self.counted = k, percent, members, counted
        context = docs.sparkSession.sparkContext
        common = context.broadcast(self._common(C.BROADCAST_BYTES // 8))
        self.own = C.checkpointed(C.mapped(self.docs, _scanned(k, percent, common), _OWN))
        common.destroy()
        lows = [f"l{i}" for i in range(LOWS)]
        ordered = self.own.where("marks is not null").repartitionByRange(*lows).sortWithinPartitions(*lows, "print")
        self.groups = C.checkpointed(C.mapped(ordered, _grouped(members, tokens), _GROUPS))
        self.prints = C.checkpointed(self.own.where("print is not null and doc_id is not null").groupBy("print").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")))

    def _common(self, most: int) -> np.ndarray:
        """Hashes of the tokens that the most prefixes hold, in order."""
        counts = C.mapped(self.docs, _frequent(self.k, self.percent), "token long").groupBy("token").count().where(F.col("count") > FREQUENT)
        top = counts.orderBy(F.desc("count"), "token").limit(most).select("token").toArrow()
        return np.sort(top["token"].to_numpy().astype(np.int64).view(np.uint64))

    def _nodes(self, *columns: str) -> DataFrame:
        """group, its number of nodes (n) and the given array columns of groups, one row a node."""
        rows = self.groups.select("group", F.size("nodes").alias("n"), F.explode(F.arrays_zip(*columns)).alias("m"))
        return rows.select("group", "n", *(F.col(f"m.{c}").alias(_ONE[c]) for c in columns))

    def _matrix(self) -> DataFrame:
        """(token, node, group, n, size, sketch, groups) of the tokens that several groups hold; groups: how many. Only tokens and nodes
        are shuffled for all prefixes."""
        rows = self._nodes("nodes", "prefixes").select("node", F.explode("prefix").alias("token"))
        over, group = Window.partitionBy("token"), F.expr(f"node div {self.members}")
        rows = rows.withColumns({"_low": F.min("node").over(over), "_high": F.max("node").over(over)})
        rows = rows.where(f"_low div {self.members} < _high div {self.members}").drop("_low", "_high")
        counts = rows.groupBy("token").agg(F.count_distinct(group).alias("groups"))
        own = self._nodes("nodes", "sizes", "sketches").withColumn("size", F.col("size").cast("long"))
        return C.checkpointed(rows.join(counts, "token").join(own, "node"))

    def _holders(self, held: DataFrame, *keys: str, **more) -> DataFrame:
        """A row for each token and group: sizes of the nodes that hold the token, and sketches of what all and any of them have."""
        words = [F.col("sketch")[i] for i in range(WORDS)]
        sketches = [f(w).alias(f"{name}{i}") for i, w in enumerate(words) for name, f in (("all", F.bit_and), ("any", F.bit_or))]
        sizes = [F.min("size").alias("least"), F.max("size").alias("most")]
        return held.groupBy("token", "group", "n", *keys).agg(*sizes, *sketches, *(c.alias(name) for name, c in more.items()))

    def _reach(self):
        """Whether nodes of two groups that hold a token may be linked, by their sizes and by what one side has and the other lacks."""
        p = self.percent
        lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}_all{i}").bitwiseAND(F.bitwise_not(f"{y}_any{i}"))) for i in range(WORDS)), F.lit(0))
        sides = [100 * F.col(f"{x}_most") - p * F.col(f"{y}_least") >= (100 + p) * lacks(x, y) for x, y in ("ab", "ba")]
        return sides[0] & sides[1]

    def _star_pairs(self, held: DataFrame) -> DataFrame:
        """(a, b): each group a with the group b that is the largest one of most of its tokens, if that has several members."""
        own = self._holders(held)
        columns = [c for c in own.columns if c not in ("token", "n")]
        hubs = own.where("n > 1").groupBy("token").agg(F.max(F.struct("n", F.xxhash64("group").alias("x"), *columns)).alias("h"))
        y = hubs.select("token", *(F.col(f"h.{c}").alias(f"b_{c}") for c in columns))
        x = own.select("token", *(F.col(c).alias(f"a_{c}") for c in columns))
        near = x.join(y, "token").where((F.col("a_group") != F.col("b_group")) & self._reach())
        best = near.groupBy("a_group", "b_group").count().groupBy(F.col("a_group").alias("a"))
        return best.agg(F.max(F.struct("count", "b_group"))["b_group"].alias("b"))

    def _sides(self, held: DataFrame) -> tuple[DataFrame, DataFrame]:
        """_holders with main, and apart: whether a node with this token is outside its group's main component; twice."""
        own = self._holders(held, "main", apart=F.max(F.col("comp") != F.col("main")))
        return tuple(own.select("token", *(F.col(c).alias(f"{s}_{c}") for c in own.columns if c != "token")) for s in "ab")

    def _ways(self, near: DataFrame) -> DataFrame:
        """(a, b, whole) of rows of two groups: where their main components differ, the smaller group a goes whole to b; else the members
        outside it go to the other group."""
        smaller = F.struct("a_n", "a_group") < F.struct("b_n", "b_group")
        pair = lambda x, y, whole: F.struct(F.col(f"{x}_group").alias("a"), F.col(f"{y}_group").alias("b"), F.lit(whole).alias("whole"))
        apart = F.array(*(F.when(F.col(f"{x}_apart"), pair(x, y, False)) for x, y in ("ab", "ba")))
        ways = F.when(F.col("a_main") != F.col("b_main"), F.array(F.when(smaller, pair("a", "b", True)).otherwise(pair("b", "a", True)))).otherwise(apart)
        return near.select(F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("w")).select("w.*").distinct()

    def _open_pairs(self, held: DataFrame) -> DataFrame:
        """Pairs that share tokens of few groups. Where the nodes that hold them are of one size, they must share as many tokens as a link
        needs: the others can all lie in the larger set's part behind its prefix, and no more."""
        p = self.percent
        x, y = self._sides(held.where(F.col("groups") <= CROWD))
        open_ = (F.col("a_main") != F.col("b_main")) | F.col("a_apart") | F.col("b_apart")
        near = x.join(y, (x["token"] == y["token"]) & (F.col("a_group") < F.col("b_group")) & open_ & self._reach())
        names = [f"{s}_{c}" for s in "ab" for c in ("group", "n", "main")]
        kept = [f(f"{s}_{c}").alias(f"{s}_{c}") for s in "ab" for c, f in (("least", F.min), ("most", F.max), ("apart", F.max))]
        shared = near.groupBy(*names).agg(F.count("*").alias("c"), *kept)
        behind = F.expr(f"({p} * greatest(a_most, b_most) + 99) div 100 - 1")
        enough = (F.col("c") + behind) * (100 + p) >= p * (F.col("a_most") + F.col("b_most"))
        return self._ways(shared.where((F.col("a_least") < F.col("a_most")) | (F.col("b_least") < F.col("b_most")) | enough))

    def _crowded_pairs(self, held: DataFrame) -> DataFrame:
        """Pairs that share tokens of many groups: of each such token the groups that aren't mainly of the component of most of its groups, or
        have a node apart, with all others. What is apart in the second group is a row of its own."""
        x, y = self._sides(held.where(F.col("groups") > CROWD))
        usual = x.groupBy("token", "a_main").count().groupBy("token").agg(F.max(F.struct("count", "a_main"))["a_main"].alias("usual"))
        minor = x.join(usual, "token").where("a_main <> usual or a_apart")
        settled = (F.col("b_main") == F.col("usual")) & ~F.col("b_apart")
        once = F.when(F.col("a_main") == F.col("b_main"), F.col("a_apart")).otherwise(settled | (F.col("a_group") < F.col("b_group")))
        near = minor.join(y, (minor["token"] == y["token"]) & (F.col("a_group") != F.col("b_group")) & once & self._reach())
        return self._ways(near.withColumn("b_apart", F.lit(False)))

    def _qualified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, whole) that bitmaps don't rule out, with the nodes that may have links (xs of a, ys of b), stored."""
        for s in "ab":
            pairs = pairs.join(self.groups.select(F.col("group").alias(s), F.col("sizes").alias(f"sizes_{s}"), F.col("marks").alias(f"marks_{s}")), s)
        return C.checkpointed(C.mapped(pairs, _qualified(self.percent, self.members), _PAIRS))

    def _members(self, rows: DataFrame, labels: DataFrame | None) -> DataFrame:
        """group, members (node, copies, comp, set) of nodes (group, node, doc_id, print), stored. A bitmap of hashed ids tells which texts
        are read again: those of the nodes and few others."""
        rows = rows.join(self.prints.select("print", "copies"), "print")
        if labels is not None:
            rows = rows.join(labels, "node", "left")
        rows = C.checkpointed(rows.withColumn("comp", F.coalesce("comp", "node") if labels is not None else F.col("node")))
        ids = C.checkpointed(rows.select("doc_id").distinct())
        slots = min(8 * C.BROADCAST_BYTES, 1 << max(10, (64 * ids.count()).bit_length()))
        at = F.pmod(F.xxhash64("doc_id"), F.lit(slots))
        cells = ids.select(at.alias("slot")).groupBy(F.expr("slot div 64").alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toArrow()
        wanted = np.zeros(slots // 64, np.uint64)
        wanted[cells["i"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
        wanted = self.docs.sparkSession.sparkContext.broadcast(wanted)
        docs = self.docs.where("doc_id is not null").withColumn("slot", at)
        sets = C.mapped(docs, _sets(self.k, wanted), "doc_id long, print binary, set binary").join(rows, ["doc_id", "print"])
        own = C.checkpointed(sets.groupBy("group").agg(F.collect_set(F.struct("node", "copies", "comp", "set")).alias("members")))
        wanted.destroy()
        return own

    def _opened(self, rows: DataFrame, run) -> DataFrame:
        return C.checkpointed(C.mapped(rows, run(self.percent, self.counted), "a long, b long, links long"))

    def _compared(self, pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Links of pairs (a, b, xs, ys and, if not whole, main: the component whose members of a are left out)."""
        used = C.checkpointed(pairs.select(F.explode(F.concat("xs", "ys")).alias("node")).distinct())
        rows = self._nodes("nodes", "docs", "prints").join(C.few(used), "node", "left_semi")
        own = self._members(rows.select("group", "node", "doc_id", "print"), labels)
        x = pairs.join(own.select(F.col("group").alias("a"), "members"), "a")
        left = F.filter("members", lambda m: F.array_contains("xs", m["node"]) & (F.col("whole") | (m["comp"] != F.col("main"))))
        right = F.filter("members", lambda m: F.array_contains("ys", m["node"]))
        x = x.select("b", "ys", left.alias("members_a")).where(F.size("members_a") > 0)
        return self._opened(x.join(own.withColumnRenamed("group", "b"), "b").select("members_a", right.alias("members_b")), _joined)

    def _labelled(self, held: DataFrame, labels: DataFrame) -> DataFrame:
        """held with the component of each node (comp) and that of most nodes of its group (main)."""
        own = self.groups.join(held.select("group").distinct(), "group", "left_semi").select("group", F.explode("nodes").alias("node"))
        own = C.checkpointed(own.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        mains = own.groupBy("group", "comp").count().groupBy("group").agg(F.max(F.struct("count", "comp"))["comp"].alias("main"))
        return C.checkpointed(held.join(own.select("node", "comp"), "node").join(mains, "group"))

    def _merged(self, labels: DataFrame, links: DataFrame) -> DataFrame:
        """Labels (node, comp) after links between components, of which those without a label are single nodes. Only components that links
        name go through rounds, not all that is labelled."""
        low = connected_components(links).toDF("part", "low")
        both = labels.join(low, F.col("comp") == F.col("part"), "full")
        return C.checkpointed(both.select(F.coalesce("node", "part").alias("node"), F.coalesce("low", "comp").alias("comp")))

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Components (node, comp) of all nodes with links, and, if counted, numbers of documents linked (node, links; several rows a node)."""
        held = self._matrix()
        several = self._nodes("nodes", "docs", "prints").where("n > 1").select("group", "node", "doc_id", "print")
        settled = self._opened(self._members(several, None).select("members"), _settled)
        labels = settled.where("b is not null").select(F.col("a").alias("node"), F.col("b").alias("comp"))
        degrees = settled.where("b is null").select(F.col("a").alias("node"), "links")
        if self.counted:  # every pair, as if no group were settled
            held = held.withColumns({"comp": F.col("group"), "main": F.col("group"), "groups": F.lit(0)})
            pairs = self._qualified(self._open_pairs(held))
            links = self._compared(pairs.withColumn("main", F.lit(None).cast("long")), labels)
            degrees = degrees.union(links.where("b is null").select("a", "links"))
            return self._merged(labels, links.where("b is not null")), degrees
        stars = C.checkpointed(self._star_pairs(held))
        pairs = self._qualified(stars.withColumn("whole", F.lit(True)))
        labels = self._merged(labels, self._compared(pairs.withColumn("main", F.lit(None).cast("long")), labels))
        held = self._labelled(held, labels)
        rest = C.checkpointed(self._open_pairs(held).union(self._crowded_pairs(held)).distinct())
        tested = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pairs = self._qualified(rest.join(tested, ["a", "b"], "left_anti"))
        mains = held.select(F.col("group").alias("a"), "main").distinct()
        return self._merged(labels, self._compared(pairs.join(mains, "a"), labels)), degrees

    def result(self) -> DataFrame:
        labels, links = self.links()
        zipped = F.explode(F.arrays_zip("nodes", "prints")).alias("m")
        nodes = self.groups.select(zipped).select(F.col("m.nodes").alias("node"), F.col("m.prints").alias("print"))
        degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
        known = labels.join(degrees, "node", "left").join(nodes, "node").join(self.prints, "print")
        known = C.checkpointed(known.select("print", "comp", "links", "first"))
        least = known.groupBy("comp").agg(F.min("first").alias("least"))
        of_print = self.prints.where("copies > 1").join(known.drop("first"), "print", "full").join(least, "comp", "left")
        of_print = of_print.select("print", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("least", "first").alias("c"))
        rows = self.own.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("print")).alias("print"))
        joined = rows.join(of_print, "print", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
        return joined if self.counted else joined.drop("n_links")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, members: int = 256, tokens: int = 1 << 17, counted: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links) and, if counted, n_links (documents linked with
    it). Documents are linked if their sets of k-word shingles have a Jaccard similarity of percent / 100 or more."""
    return Join(docs, k, percent, members, tokens, counted).result()


def op12_ngram_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=4, percent=85)


#: The same in DuckDB, by comparing all pairs that share a shingle.
OP12_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(4, len(w)) - 1], ' ') || CASE WHEN len(w) < 4 THEN ' short' ELSE '' END) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS i FROM d WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
