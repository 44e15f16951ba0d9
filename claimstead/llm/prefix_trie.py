"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids, built by ranges of sorted keys."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small

#: Bytes of a turn id, turns of a key at most (longer conversations go on in further keys), keys of a range at most in expectation.
ID, TURNS, RANGE = 16, 64, 20_000

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class Node:
    """An inner node or leaf of an adaptive radix tree. `prefix` are the bytes between its edge and itself (path compression); `ends` the items whose key ends here.

    Children lie in one of four layouts, each left for the next when it is full: up to 4 or up to 16 sorted edge bytes beside a list, an index of 256 places
    into a list of up to 48, and a list by edge byte.
    """

    __slots__ = ("edges", "ends", "kids", "prefix")
    SMALL, INDEXED = 16, 48

    def __init__(self, prefix: bytes):
        self.prefix, self.edges, self.kids, self.ends = prefix, bytearray(), [], []

    @property
    def layout(self) -> int:
        n = len(self.kids)
        return 256 if self.edges is None else 48 if len(self.edges) == 256 else 4 if n <= 4 else 16

    def get(self, edge: int) -> Node | None:
        if self.edges is None:
            return self.kids[edge]
        if len(self.edges) == 256:
            at = self.edges[edge]
            return self.kids[at - 1] if at else None
        at = bisect_left(self.edges, edge)
        return self.kids[at] if at < len(self.edges) and self.edges[at] == edge else None

    def put(self, edge: int, kid: Node) -> None:
        """Set the child of an edge, moving to the next layout where this one is full."""
        if self.edges is None:
            self.kids[edge] = kid
            return
        if len(self.edges) == 256:
            if self.edges[edge]:
                self.kids[self.edges[edge] - 1] = kid
            elif len(self.kids) < self.INDEXED:
                self.kids.append(kid)
                self.edges[edge] = len(self.kids)
            else:
                self.kids = [self.kids[at - 1] if at else None for at in self.edges]
                self.edges = None
                self.kids[edge] = kid
            return
        at = bisect_left(self.edges, edge)
        if at < len(self.edges) and self.edges[at] == edge:
            self.kids[at] = kid
        elif len(self.kids) < self.SMALL:
            self.edges.insert(at, edge)
            self.kids.insert(at, kid)
        else:
            index = bytearray(256)
            for place, e in enumerate(self.edges, 1):
                index[e] = place
            self.edges = index
            self.put(edge, kid)

    def children(self) -> list[Node]:
        """In no particular order."""
        return [k for k in self.kids if k is not None]


class Tree:
    """Adaptive radix tree of byte keys, one of which may be a prefix of another."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def add(self, key: bytes, item) -> None:
        node, at = self.root, 0
        while at < len(key):
            kid = node.get(key[at])
            if kid is None:
                kid = Node(key[at + 1 :])
                node.put(key[at], kid)
                node, at = kid, len(key)
                break
            rest, own = key[at + 1 : at + 1 + len(kid.prefix)], kid.prefix
            if rest != own:
                same = next((i for i, (a, b) in enumerate(zip(rest, own)) if a != b), min(len(rest), len(own)))  # noqa: B905
                above = Node(own[:same])
                above.put(own[same], kid)
                kid.prefix = own[same + 1 :]
                node.put(key[at], above)
                kid = above
            node, at = kid, at + 1 + len(kid.prefix)
        node.ends.append(item)


def ref(trie: bytes, key: bytes) -> bytes:
    """Name of a node: its trie and the key that leads to it. The name of a full key's node is the trie of what follows."""
    return hashlib.md5(trie + hashlib.md5(key).digest()).digest()


class _Sum:
    """What is known of a part of a tree: members, their least id, nodes without a parent so far, leaves and saved tokens below, one key, and whether the range's first or last row lies in it."""

    __slots__ = ("edge", "kids", "leaves", "least", "lens", "n", "orphans", "saved")

    def __init__(self) -> None:
        self.n, self.least, self.kids, self.leaves, self.saved, self.orphans, self.lens, self.edge = 0, None, 0, 0, 0, [], None, False

    def add(self, other: _Sum) -> None:
        self.n += other.n
        self.least = other.least if self.least is None else min(self.least, other.least)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.orphans += other.orphans
        self.lens = self.lens or other.lens
        self.edge |= other.edge


def _text(ids: list[int]) -> bytes:
    return b",".join(b"%d" % c for c in sorted(ids))


def _fold(tree: Tree, trie: bytes, base: int, full: int, first: bytes | None, last: bytes | None) -> tuple[list, dict]:
    """Closed nodes of a tree, and its open ones: those on the way to the range's first or last key, which other ranges may share.

    Closed: [conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends, ref, parent_ref]. Open: by depth in the key (n, least, kids,
    leaves, saved, bytes, ends, tail), of closed parts only. Only depths at a turn's end give nodes; a node within an id passes its parts on.
    """
    closed: list[list] = []
    open_: dict[bytes, tuple] = {}
    stack: list[tuple] = [(tree.root, b"", None)]
    order = []
    while stack:
        node, before, above = stack.pop()
        path = before + node.prefix
        order.append((node, len(before) - (1 if above is not None else 0), path, above))
        for edge, kid in enumerate(node.kids) if node.edges is None else ((e, node.get(e)) for e in (node.edges if len(node.edges) != 256 else range(256))):
            if kid is not None:
                stack.append((kid, path + bytes([edge]), node))
    sums = {id(node): _Sum() for node, *_ in order}
    for node, start, path, above in reversed(order):
        total, own = sums.pop(id(node)), []
        for conv, lens, more, tail, edge in node.ends:
            one = _Sum()
            one.n, one.least, one.lens, one.edge = 1, conv, lens, edge
            total.add(one)
            if not more:
                own.append(conv)
        tail = next((t for _, _, more, t, _ in node.ends if more), None)
        if total.n:
            lowest = 0 if above is None else (start // ID + 1) * ID
            for d in range(len(path) // ID * ID, lowest - 1, -ID):
                ends = _text(own) if d == len(path) and own else None
                more = tail if d == len(path) else None
                key, size = path[:d], total.lens[d // ID - 1] if d else 0
                # a part whose turns are shared with a neighbour's stays open until ranges are merged
                if total.edge and ((first is not None and first[:d] == key) or (last is not None and last[:d] == key)):
                    for x in total.orphans:
                        x[9] = ref(trie, key) if d or not base else trie
                    open_[key] = (total.n, total.least, total.kids, total.leaves, total.saved, size, ends, more)
                    total.kids, total.leaves, total.saved, total.orphans = 0, 0, 0, []
                    continue
                if more:
                    total.kids, total.leaves, total.saved = total.kids + more[0], total.leaves + more[1], total.saved + more[2]
                if not total.kids:
                    total.leaves = 1
                total.saved += (total.n - 1) * size
                row = [total.least, base + d // ID, None, total.n, total.kids, total.leaves, total.saved, hashlib.sha256(ends or b"").hexdigest(), ref(trie, key) if d == full else None, None]
                for x in total.orphans:
                    x[2 if d or not base else 9] = total.least if d or not base else trie
                closed.append(row)
                total.kids, total.orphans = 1, [row]
        if above is not None:
            sums[id(above)].add(total)
    return closed, open_


PART = f"kind int, {NODE}, ref binary, parent_ref binary, first_trie binary, first_key binary, first_conv long, trie binary, level long, key binary, parts array<struct<n: long, least: long, kids: long, leaves: long, saved: long, bytes: long, ends: binary, tail: array<long>>>"


def _ranges(width: int):
    """Arrow batches of one sorted range of keys to its closed nodes (kind 0) and, for its first and its last key, the parts of their open nodes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x["trie"], x["key"], x["conv"], x["level"], x["lens"], x["more"], x["tail"]) for b in batches for x in b.to_pylist()]
        if not rows:
            return
        edge = [rows[0], rows[-1]]
        out: list[tuple] = []
        for trie, group in groupby(rows, key=lambda r: r[0]):
            tree, level = Tree(), 0
            for row in group:
                tree.add(row[1], (row[2], row[4], row[5], row[6], row is edge[0] or row is edge[1]))
                level = row[3]
            first = edge[0][1] if trie == edge[0][0] else None
            last = edge[1][1] if trie == edge[1][0] else None
            closed, open_ = _fold(tree, trie, level * width, width * ID, first, last)
            blank = (None,) * 7
            # the root of a later trie stands for the node that its trie is named after, so it is told as its trie's sums only
            out += [(0, *x, *blank) if not (level and x[1] == level * width) else (2, *x, None, None, None, trie, level, None, None) for x in closed]
            ways = [w for w in dict.fromkeys((first, last)) if w is not None]
            told: set[bytes] = set()
            for way in ways:
                parts = [None if way[:d] in told else open_[way[:d]] for d in range(0, len(way) + 1, ID)]
                told |= {way[:d] for d in range(0, len(way) + 1, ID)}
                out.append((1, *(None,) * 10, edge[0][0], edge[0][1], edge[0][2], trie, level, way, parts))
        yield from _rows(out)

    return run


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
_OPEN = pa.struct([*((c, pa.int64()) for c in ("n", "least", "kids", "leaves", "saved", "bytes")), ("ends", pa.binary()), ("tail", pa.list_(pa.int64()))])
_PART = pa.schema([*((c.split(" ")[0], _TYPES[c.split(" ")[1]]) for c in PART.split(", parts ")[0].split(", ")), ("parts", pa.list_(_OPEN))])


def _rows(rows: list[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Batches of PART; open parts are tuples in the order of the struct's fields."""
    for at in range(0, len(rows), size):
        columns = [list(c) for c in zip(*rows[at : at + size], strict=True)]
        columns[-1] = [parts and [p and dict(zip(_OPEN.names, p, strict=True)) for p in parts] for parts in columns[-1]]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PART, strict=True)], schema=_PART)


def _merged(width: int):
    """Open nodes of all ranges, in the order of the ranges: their parts summed, then from the deepest up. Two keys a range, so as many rows as ranges, not as conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[bytes, bytes], list] = {}
        for row in (r for b in batches for r in b.to_pylist()):
            for at, p in enumerate(row["parts"]):
                if p is None:
                    continue
                node = found.setdefault((row["trie"], row["key"][: at * ID]), [row["level"], 0, None, 0, 0, 0, 0, hashlib.sha256(), False, None])
                node[1] += p["n"]
                node[2] = p["least"] if node[2] is None else min(node[2], p["least"])
                for i, k in enumerate(("kids", "leaves", "saved"), 3):
                    node[i] += p[k]
                node[6] = p["bytes"]
                if p["ends"] is not None:
                    node[7].update(b"," * node[8] + p["ends"])
                    node[8] = True
                node[9] = node[9] or p["tail"]
        out = []
        for (trie, key), node in sorted(found.items(), key=lambda x: -len(x[0][1])):
            level, n, least, kids, leaves, saved, size, ends, _, tail = node
            if tail:
                kids, leaves, saved = kids + tail[0], leaves + tail[1], saved + tail[2]
            leaves, saved = leaves if kids else 1, saved + (n - 1) * size
            above = found.get((trie, key[:-ID])) if key else None
            if above:
                above[3], above[4], above[5] = above[3] + 1, above[4] + leaves, above[5] + saved
            later = level and len(key) == ID  # hangs below the node that its trie is named after
            row = (least, level * width + len(key) // ID, above[2] if above and not later else None, n, kids, leaves, saved, ends.hexdigest(), ref(trie, key), trie if later else None)
            out.append((2 if level and not key else 0, *row, None, None, None, trie, level, None, None))
        yield from _rows(out)

    return run


def _level(keys: DataFrame, width: int, per_range: int) -> DataFrame:
    """Parts of all nodes of some tries (PART): keys go to ranges of trie, key and id, so that no prefix, however common, and no key, however often repeated, lies in one task alone."""
    n = max(1, -(-keys.count() // per_range))
    order = ["trie", "key", "conv"]
    dealt = keys.repartitionByRange(n, *order).sortWithinPartitions(*order)
    parts = cut(dealt.mapInArrow(_ranges(width), PART))
    # two rows a range at most: bounded by the number of ranges
    open_ = parts.where("kind = 1").repartition(1).sortWithinPartitions("first_trie", "first_key", "first_conv", "trie", "key").mapInArrow(_merged(width), PART)
    return parts.where("kind <> 1").unionByName(open_)


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn: MD5 of its role, with the role's length before it, and text."""
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def placed(conversations: DataFrame, per_range: int = RANGE) -> DataFrame:
    """conv_id, pos, id, bytes: the turns of each conversation in their order (null first; equal turns by id), numbered from 0.

    Turns are sorted in ranges of (conv_id, turn), so a conversation of very many turns is spread. Where a range begins within a conversation it
    counts on from the ranges before: one number a range. Rows without a conv_id belong to no conversation.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turns = cut(conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(role, text).alias("id"), F.octet_length(text).alias("bytes")))
    n = max(1, -(-turns.count() // per_range))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("id")]
    dealt = turns.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "id", "bytes")
    dealt = cut(dealt.mapInArrow(_numbered, "conv_id long, id binary, bytes int, part int, line long"))
    runs = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("held"))
    over = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # of the conversations in a range only the first can have begun before it, so there is a row a range at most
    later = runs.withColumn("before", F.sum("held").over(over)).where("before IS NOT NULL").select("conv_id", "part", "before")
    joined = dealt.join(small(later), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("line") + F.coalesce("before", F.lit(0))).alias("pos"), "id", "bytes")


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conv_id, with the range's number and their place in their conversation's part of the range."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        convs = b.column("conv_id").to_numpy(zero_copy_only=False)
        if not len(convs):
            continue
        heads = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1]])
        line = np.arange(len(convs)) - np.repeat(heads, np.diff(np.r_[heads, len(convs)]))
        if last == convs[0]:
            line[: heads[1] if len(heads) > 1 else None] += at
        last, at = convs[-1], int(line[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(convs), part, np.int32)), pa.array(line.astype(np.int64))], [*b.schema.names, "part", "line"])


def rebuilt(turns: DataFrame, lengths: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that begin with the first h turns of the conversation c - c % group, h = crc32(c) % heads, and go on with their own after the first h.

    turns: conv_id, pos, id, bytes; lengths: conv_id, total. The turns come with their conversation's total.
    """
    base, h = F.col("conv_id") - F.col("conv_id") % group, F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    of = lengths.select(F.col("conv_id").alias("base"), F.col("total").alias("base_total"))
    plan = lengths.withColumnRenamed("total", "own").withColumns({"base": base, "h": h}).join(of, "base", "left")
    plan = plan.withColumn("used", F.least("h", F.coalesce("base_total", F.lit(0)))).withColumn("total", F.col("used") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = cut(plan.select("conv_id", "base", "h", "used", "total"))
    # at most heads - 1 turns of a base, for each of its few conversations
    first = turns.where(F.col("pos") < heads - 1).withColumnRenamed("conv_id", "base").join(plan, "base").where("pos < used")
    rest = turns.join(plan, "conv_id").where("pos >= h").withColumn("pos", F.col("pos") - F.col("h") + F.col("used"))
    columns = ["conv_id", "total", "pos", "id", "bytes"]
    return first.select(columns).unionByName(rest.select(columns)), plan.select("conv_id", "total")


def keys_of(turns: DataFrame, lengths: DataFrame, width: int = TURNS) -> DataFrame:
    """trie, key, conv, level, lens, more, tail: `width` turns a key; a conversation longer than that goes on in the trie that is named after its first keys.

    turns: conv_id, pos, id, bytes; lengths: conv_id, total of all conversations, also those without turns. tail is null.
    """
    whole = turns if "total" in turns.columns else turns.join(lengths, "conv_id")
    level = F.floor(F.col("pos") / width).cast("long")
    grouped = whole.groupBy("conv_id", "total", level.alias("level")).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "bytes"))).alias("t"))
    key = F.aggregate(F.col("t"), F.lit(b""), lambda a, x: F.concat(a, x["id"]))
    keys = grouped.select(F.col("conv_id").alias("conv"), "level", key.alias("key"), F.transform("t", lambda x: x["bytes"].cast("long")).alias("lens"), ((F.col("level") + 1) * width < F.col("total")).alias("more"), (F.col("total") > width).alias("long"))
    none = lengths.where("total = 0").select(F.col("conv_id").alias("conv"), F.lit(0).cast("long").alias("level"), F.lit(b"").alias("key"), F.array().cast("array<long>").alias("lens"), F.lit(False).alias("more"), F.lit(False).alias("long"))
    keys = cut(keys.unionByName(none))
    if keys.where("long").isEmpty():
        return keys.select(F.lit(b"").alias("trie"), "key", "conv", "level", "lens", "more", F.lit(None).cast("array<long>").alias("tail"))
    # long conversations: a key's trie hangs on all keys before it; one task walks a conversation's keys, 16 bytes for each `width` turns
    chain = keys.where("long").select("conv", "level", F.unhex(F.md5("key")).alias("own")).repartition("conv").sortWithinPartitions("conv", "level")
    named = cut(chain.mapInArrow(_chain, "conv long, level long, trie binary"))
    found = keys.where("long").join(named, ["conv", "level"]).unionByName(keys.where("NOT long").withColumn("trie", F.lit(b"")))
    return found.select("trie", "key", "conv", "level", "lens", "more", F.lit(None).cast("array<long>").alias("tail"))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, trie = None, b""
    for b in batches:
        out = []
        for x in b.to_pylist():
            if x["conv"] != conv:
                conv, trie = x["conv"], b""
            out.append(trie)
            trie = hashlib.md5(trie + x["own"]).digest()
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("level"), pa.array(out, pa.binary())], ["conv", "level", "trie"])


def nodes(turns: DataFrame, lengths: DataFrame, width: int = TURNS, per_range: int = RANGE) -> DataFrame:
    """A row for each distinct sequence of first turns (NODE), from the root on, none for an empty table.

    turns: conv_id, pos (from 0), id (16 bytes, equal for equal turns), bytes; lengths: conv_id, total for every conversation. A conversation's keys of `width` turns
    are sorted with all others and cut into ranges; each task builds an adaptive radix tree of its range and reports nodes that lie in it
    whole; nodes on its two edge keys are merged over all ranges. So neither a common first turn nor copies of one conversation load one task;
    the SHA-256 of very many ends is a sequence by nature and takes a row a range. Later tries are worked from the deepest shared one up, then
    those of a single conversation together with the first ones.
    """
    keys = keys_of(turns, lengths, width)
    if keys.where("level > 0").isEmpty():
        return _parents(cut(_level(keys, width, per_range)).where("kind = 0"))
    many = cut(keys.where("level > 0").groupBy("trie", "level").agg(F.count(F.lit(1)).alias("n")))
    shared = many.where("n > 1").select("trie")
    # as many numbers as keys in the longest beginning that two conversations share
    levels = [r["level"] for r in many.where("n > 1").select("level").distinct().orderBy(F.desc("level")).collect()]
    below = many.where("n = 1").select(F.col("trie").alias("next"), F.array(*[F.lit(x).cast("long") for x in (1, 1, 0)]).alias("below"))
    found = None
    for level in [*levels, 0]:
        if level:
            part = keys.where(F.col("level") == level).join(shared, "trie", "left_semi")
        else:
            part = keys.where("level = 0").unionByName(keys.where("level > 0").join(shared, "trie", "left_anti"))
        name = F.unhex(F.md5(F.concat("trie", F.unhex(F.md5("key")))))
        further = part.where("more").drop("tail").withColumn("next", name).join(below, "next", "left").drop("next").withColumnRenamed("below", "tail")
        done = cut(_level(cut(part.where("NOT more").unionByName(further)), width, per_range))
        below = below.unionByName(done.where("kind = 2").select(F.col("trie").alias("next"), F.array("n_children", "n_leaves", "saved_tokens").alias("below")))
        found = done.where("kind = 0") if found is None else found.unionByName(done.where("kind = 0"))
    return _parents(found)


#: Rows of (16 bytes, number) up to which a broadcast is asked for: some 10 MB.
NAMES = 200_000


def _parents(found: DataFrame) -> DataFrame:
    """NODE, with the parents that were open or in an earlier trie looked up by name."""
    names = found.where("ref IS NOT NULL").select(F.col("ref").alias("parent_ref"), F.col("conv_id").alias("_parent"))
    names = F.broadcast(names) if names.count() <= NAMES else names
    columns = [f.split(" ")[0] for f in NODE.split(", ")]
    looked = found.where("parent_ref IS NOT NULL").join(names, "parent_ref", "left").withColumn("parent_conv_id", F.col("_parent"))
    return found.where("parent_ref IS NULL").select(columns).unionByName(looked.select(columns))


def conversation_trie(conversations: DataFrame, width: int = TURNS, per_range: int = RANGE) -> DataFrame:
    """Trie nodes of conversations as they are: `placed`, then `nodes`."""
    turns = cut(placed(conversations, per_range))
    return nodes(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")), width, per_range)


def op11_prefix_trie(spark: SparkSession, sf_dir: str, width: int = TURNS, per_range: int = RANGE) -> DataFrame:
    """Nodes of the trie of rebuilt conversations over all of `conversations`.

    Turns equal in number are ordered by their ids (MD5 of role and text). Null roles and texts are empty; rows without a conv_id are left out;
    repeated rows are turns of their own; an empty table has no nodes; other columns are not read.
    """
    turns = cut(placed(spark.read.parquet(f"{sf_dir}/conversations.parquet"), per_range))
    whole, lengths = rebuilt(turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total")))
    return nodes(whole, lengths, width, per_range)


OP11_SQL = """
WITH RECURSIVE c AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, turn FROM conversations WHERE conv_id IS NOT NULL
), t AS (SELECT conv_id, id, strlen(text) AS bytes, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS pos FROM c),
convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, CAST(xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) AS BIGINT) % 9 AS h FROM t
), own AS (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY ALL),
r AS (
  SELECT k.conv_id, t.pos, t.id, t.bytes FROM convs k JOIN t ON t.conv_id = k.base WHERE t.pos < k.h
  UNION ALL SELECT k.conv_id, t.pos - k.h + least(k.h, coalesce(o.n, 0)), t.id, t.bytes FROM convs k JOIN t USING (conv_id) LEFT JOIN own o ON o.base = k.base WHERE t.pos >= k.h
), walk AS (
  SELECT conv_id, 0 AS depth, '' AS name, 0 AS bytes FROM convs
  UNION ALL SELECT w.conv_id, w.depth + 1, md5(concat(w.name, r.id)), r.bytes FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.pos = w.depth
), ends AS (SELECT conv_id, max(depth) AS total FROM walk GROUP BY conv_id),
node AS (
  SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
  FROM walk JOIN ends USING (conv_id) GROUP BY depth, name
), up AS (SELECT n.depth, n.name, p.name AS parent FROM node n JOIN walk p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS name, count(*) AS n FROM up GROUP BY ALL),
below AS (
  SELECT a.depth, a.name, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved
  FROM node n LEFT JOIN kids k USING (depth, name) JOIN walk a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b USING (depth, name) LEFT JOIN kids k USING (depth, name) LEFT JOIN up u USING (depth, name) LEFT JOIN node p ON p.depth = n.depth - 1 AND p.name = u.parent"""
