"""Prefix trie of conversations as a burst trie: containers of suffixes under trie heads.

Conversations are rebuilt first: conversation c starts with the first h turns of conversation c - c % 5 (h is the CRC-32
of c in decimal, modulo 9) and goes on with its own turns after its first h. A node is a distinct sequence of first turns.

* Equal conversations are folded to one with a count before anything else, so a hot one is one row.
* A conversation is cut into suffixes of at most :data:`SEGMENT` turns. Each lies in the container of its head, the node
  that all turns before it lead to; so a conversation of any length is rows of bounded size, and no container waits for
  another one.
* A container of more than :data:`CONTAINER` turns bursts: its head becomes a node, and its suffixes, less their first
  turn, go to the containers of the head's children. Rounds end when no container is too large, after at most SEGMENT
  ones.
* The remaining containers are dealt over tasks, sorted, and swept: a suffix shares the path of the one before it as far
  as both agree, and what lies beyond opens new nodes.

Sums over subtrees need no walk up the trie, however deep it is. Each node is owned by its smallest member. The distinct
texts below a node are then what its members own, less what its smallest member owns above it, and its leaves are the
members that own a leaf. So the containers are swept twice: once for what each conversation owns, then for the sums.

Turns stand by turn (null first), then role, then text, null roles and texts as empty strings; repeated turns count each.
Rows without a conversation id are left out. A conversation may be rebuilt without turns; it is a member of the root alone.
Texts are hashed whole, with their role, to 128 bits of SHA-256. An empty table gives an empty table, without a root. Only
the four columns are read, so further ones of any name do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillframe.llm.storage import dealt_anew, lookup, written
from quillframe.operators.planning import sums_before

SEGMENT = 64
CONTAINER = 20_000
#: Conversations start with the turns of one whose id is a multiple of this.
SHARED = 5
MOST_SHARED = 8
ROOT = "root"
SUMS = ("n", "w", "own", "leaf")

TURNS = "array<struct<key: binary, bytes: long>>"
NODE = (
    "conv_id long, depth long, above long, n long, children long, leaf long, w long, own long, low_own long, low_total long, "
    "before long, bytes long, ending long, joint string, stub string"
)


def _hash(*parts: Column) -> Column:
    return F.substr(F.sha2(F.concat(*parts), 256), F.lit(1), F.lit(32))


# --- rebuilding -------------------------------------------------------------------------------------------------------


def _placed(conversations: DataFrame) -> DataFrame:
    """(conv_id, nth, key, bytes): turns in order, nth from 0. Texts are carried only where they decide the order."""
    named = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    size = F.octet_length("text").cast("long")
    key = F.unhex(_hash(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    keyed = written(named.select("conv_id", "turn", "role", F.lit("").alias("told"), key.alias("key"), size.alias("bytes")), "turns")
    tied = written(keyed.groupBy("conv_id", "turn", "role").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b"), "tied")
    if not tied.isEmpty():
        ties = tied.select(F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.col("role").alias("_r"))
        same = (F.col("conv_id") == F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("role") == F.col("_r"))
        told = F.when(F.col("_c").isNotNull(), F.col("text")).otherwise("")
        joined = named.join(lookup(ties), same, "left")
        keyed = joined.select("conv_id", "turn", "role", told.alias("told"), key.alias("key"), size.alias("bytes"))
    return sums_before(keyed, ["conv_id"], ["turn", "role", "told"], nth=F.lit(1)).select("conv_id", "nth", "key", "bytes")


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (conv_id, len, place, key, bytes), place from 0, and (conv_id, len) of every conversation."""
    placed = written(_placed(conversations), "placed")
    first = F.sort_array(F.collect_list(F.struct("nth", "key", "bytes")))
    bases = placed.where((F.col("conv_id") % SHARED == 0) & (F.col("nth") < MOST_SHARED))
    heads = bases.groupBy(F.col("conv_id").alias("_base")).agg(first.alias("head"))
    ids = placed.groupBy("conv_id").agg(F.count("*").alias("_n"))
    lent = (F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)).cast("int")
    joined = ids.join(heads, F.col("conv_id") - F.col("conv_id") % SHARED == F.col("_base"), "left").withColumn("_lent", lent)
    taken = F.least(F.col("_lent"), F.coalesce(F.size("head"), F.lit(0)))
    whole = joined.select("conv_id", "_lent", taken.alias("_taken"), "head", (taken + F.greatest(F.col("_n") - F.col("_lent"), F.lit(0))).cast("long").alias("len"))
    plan = written(whole, "plan")
    moves = plan.select(F.col("conv_id").alias("_c"), "_lent", "_taken", "len")
    own = dealt_anew(placed, "conv_id").join(moves, (F.col("conv_id") == F.col("_c")) & (F.col("nth") >= F.col("_lent")))
    kept = own.select("conv_id", "len", (F.col("nth") - F.col("_lent") + F.col("_taken")).cast("long").alias("place"), "key", "bytes")
    started = plan.where("_taken > 0").select("conv_id", "len", F.inline(F.slice("head", F.lit(1), F.col("_taken"))))
    return kept.unionByName(started.withColumnRenamed("nth", "place")), plan.select("conv_id", "len")


# --- suffixes under heads ---------------------------------------------------------------------------------------------


def _segments(conversations: DataFrame) -> DataFrame:
    """(conv_id, len, seg, suffix, size, d1, d2, d3): each conversation in suffixes, the last of fewer than SEGMENT turns."""
    turns, every = _rebuilt(conversations)
    slot = F.struct((F.col("place") % SEGMENT).cast("int").alias("slot"), "key", "bytes")
    cut = turns.groupBy("conv_id", "len", F.floor(F.col("place") / SEGMENT).cast("long").alias("seg")).agg(F.sort_array(F.collect_list(slot)).alias("slots"))
    suffix = F.transform("slots", lambda s: F.struct(s["key"].alias("key"), s["bytes"].alias("bytes"))).cast(TURNS)
    filled = cut.select("conv_id", "len", "seg", suffix.alias("suffix"))
    ended = every.where(F.col("len") % SEGMENT == 0).select("conv_id", "len", F.floor(F.col("len") / SEGMENT).cast("long").alias("seg"), F.array().cast(TURNS).alias("suffix"))
    digest = F.sha2(F.concat(F.col("seg").cast("string"), F.lit(":"), F.array_join(F.transform("suffix", lambda s: F.hex(s["key"])), "")), 256)
    size = F.aggregate("suffix", F.lit(0).cast("long"), lambda a, s: a + s["bytes"])
    parts = {f"d{i + 1}": F.conv(F.substr(F.col("_digest"), F.lit(1 + 10 * i), F.lit(10)), 16, 10).cast("long") for i in range(3)}
    return filled.unionByName(ended).withColumn("_digest", digest).withColumns(parts).withColumn("size", size).drop("_digest")


def _sequences(segments: DataFrame) -> DataFrame:
    """(conv_id, len, seq, total): the whole sequence's hash and bytes. The hash adds up those of its suffixes."""
    summed = segments.groupBy("conv_id", "len").agg(F.sum("size").alias("total"), *(F.sum(f"d{i}").alias(f"d{i}") for i in (1, 2, 3)))
    return summed.select("conv_id", "len", F.concat_ws(":", "len", "d1", "d2", "d3").alias("seq"), "total")


def _suffixes(segments: DataFrame, sequences: DataFrame) -> DataFrame:
    """The suffixes of distinct sequences under their heads; next is the head of the suffix after, null after the last."""
    folded = sequences.groupBy("seq").agg(F.min("conv_id").alias("_low"), F.count("*").alias("n"), F.min("total").alias("total"))
    own = segments.join(folded.drop("seq"), F.col("conv_id") == F.col("_low")).drop("_low")
    one = own.where(F.col("len") < SEGMENT).withColumns({name: F.lit(0).cast("long") for name in ("before", "s1", "s2", "s3")})
    several = sums_before(own.where(F.col("len") >= SEGMENT), ["conv_id"], "seg", before=F.col("size"), s1=F.col("d1"), s2=F.col("d2"), s3=F.col("d3"))

    def head(seg: Column, *sums: Column) -> Column:
        return F.when(seg == 0, ROOT).otherwise(_hash(F.concat_ws(":", seg, *sums)))

    at = head(F.col("seg"), F.col("s1"), F.col("s2"), F.col("s3"))
    after = head(F.col("seg") + 1, *(F.col(f"s{i}") + F.col(f"d{i}") for i in (1, 2, 3)))
    return one.unionByName(several).select(
        "conv_id", "n", "total", at.alias("head"), (F.col("seg") * SEGMENT).alias("depth"), "before", "suffix",
        F.when((F.col("seg") + 1) * SEGMENT <= F.col("len"), after).alias("next"),
    )


# --- bursting and sweeping --------------------------------------------------------------------------------------------


def _folded(suffixes: DataFrame) -> DataFrame:
    """Containers' items: equal suffixes of different sequences are one, with sums over their conversations."""
    low = F.struct("conv_id", F.col("own").alias("low_own"), F.col("total").alias("low_total"))
    sums = (F.sum("n").alias("n"), F.sum(F.col("n") * F.col("total")).alias("w"), F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    return suffixes.groupBy("head", "depth", "before", "suffix", "next").agg(F.min(low).alias("low"), *sums)


def _burst(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Containers small enough to be swept, and the nodes that the others burst into."""
    no_long = F.lit(None).cast("long")
    pending = written(items.withColumns({"bytes": F.when(F.col("depth") == 0, F.lit(0).cast("long")), "above": no_long}), "items")
    small, nodes = [], []
    while True:
        over = written(pending.groupBy("head").agg(F.sum(F.size("suffix") + 1).alias("_t")).where(F.col("_t") > CONTAINER).select(F.col("head").alias("_over")), "over")
        if over.isEmpty():
            return _all([*small, pending]), _all(nodes) if nodes else None
        flagged = dealt_anew(pending, "suffix").join(lookup(over), F.col("head") == F.col("_over"), "left")
        small.append(flagged.where("_over IS NULL").drop("_over"))
        large = flagged.where("_over IS NOT NULL").drop("_over").withColumn("_turn", F.get("suffix", F.lit(0)))
        head = ("head", "depth", "before", "bytes", "above")
        sums = [F.sum(c).alias(c) for c in SUMS]
        ends = F.max(F.when(F.col("_turn").isNull(), F.col("low")["conv_id"])).alias("ending")
        by_child = large.groupBy(*head, F.col("_turn")["key"].alias("_child")).agg(F.min("low").alias("low"), ends, *sums)
        by_head = written(by_child.groupBy(*head).agg(F.min("low").alias("low"), F.max("ending").alias("ending"), F.count("_child").alias("children"), *sums), "burst")
        nodes.append(_as_nodes(by_head))
        parent = lookup(by_head.select(F.col("head").alias("_h"), F.col("low")["conv_id"].alias("_above")))
        moved = large.where("_turn IS NOT NULL").join(parent, F.col("head") == F.col("_h"))
        below = moved.select(
            _hash(F.col("head"), F.hex(F.col("_turn")["key"])).alias("head"), (F.col("depth") + 1).alias("depth"), (F.col("before") + F.col("_turn")["bytes"]).alias("before"),
            F.expr("slice(suffix, 2, size(suffix))").alias("suffix"), "next", "low", *SUMS, F.col("_turn")["bytes"].alias("bytes"), F.col("_above").alias("above"),
        )
        below = written(below, "items")
        joint = (F.size("suffix") == 0) & F.col("next").isNotNull()  # the next suffix's container has this node
        nodes.append(_as_stubs(below.where(joint)))
        pending = below.where(~joint)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _as_nodes(heads: DataFrame) -> DataFrame:
    found = heads.select(F.col("low")["conv_id"].alias("conv_id"), "*", F.col("low")["low_own"].alias("low_own"), F.col("low")["low_total"].alias("low_total"))
    joint = F.when((F.col("depth") > 0) & F.col("above").isNull(), F.col("head"))
    return _in_order(found.withColumns({"joint": joint, "stub": F.lit(None).cast("string")}))


def _as_stubs(items: DataFrame) -> DataFrame:
    return _in_order(items.select("above", "bytes", F.col("next").alias("stub")))


def _in_order(rows: DataFrame) -> DataFrame:
    fields = T._parse_datatype_string(NODE)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


class _Container:
    """The nodes of one container, opened by its sorted items."""

    def __init__(self, head: str, depth: int, before: int, size: int | None, above: int | None):
        self.head, self.above = head, above
        self.keys: list[bytes] = []  # the path that is open, below the head
        self.path = [0]
        self.nodes = [self._opened(None, depth, before, size)]

    @staticmethod
    def _opened(parent, depth, before, size) -> dict:
        return {"parent": parent, "depth": depth, "before": before, "bytes": size, "low": None, "n": 0, "w": 0, "own": 0, "leaf": 0, "children": 0, "ending": None, "stub": None}

    def add(self, suffix: list[dict], after: str | None, low: dict, sums: tuple[int, ...]) -> None:
        keys = [t["key"] for t in suffix]
        same = 0
        while same < len(keys) and same < len(self.keys) and keys[same] == self.keys[same]:
            same += 1
        del self.path[same + 1 :]
        for turn in suffix[same:]:
            up = self.nodes[self.path[-1]]
            up["children"] += 1
            self.nodes.append(self._opened(self.path[-1], up["depth"] + 1, up["before"] + turn["bytes"], turn["bytes"]))
            self.path.append(len(self.nodes) - 1)
        self.keys = keys
        for at in self.path:
            node = self.nodes[at]
            if node["low"] is None or low["conv_id"] < node["low"]["conv_id"]:
                node["low"] = low
            for name, value in zip(SUMS, sums, strict=True):
                node[name] += value
        last = self.nodes[self.path[-1]]
        if after is None:
            last["ending"] = low["conv_id"]
        else:
            last["stub"] = after

    def rows(self) -> Iterator[tuple]:
        for node in self.nodes:
            low, up = node["low"], node["parent"]
            above = self.above if up is None else self.nodes[up]["low"]["conv_id"]
            if node["stub"] is not None:
                yield None, None, above, *[None] * 8, node["bytes"], None, None, node["stub"]
                continue
            joint = self.head if up is None and node["depth"] > 0 and self.above is None else None
            yield (
                low["conv_id"], node["depth"], above, node["n"], node["children"], node["leaf"], node["w"], node["own"], low["low_own"], low["low_total"],
                node["before"], node["bytes"], node["ending"], joint, None,
            )


def _swept(items: DataFrame) -> DataFrame:
    """The nodes of small containers. A task takes a container's items in order and holds that container's nodes only."""
    target = to_arrow_schema(T._parse_datatype_string(NODE))
    names = ["head", "depth", "before", "bytes", "above", "suffix", "next", "low", *SUMS]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), target, strict=True)], schema=target)

    def run(batches):
        container, out = None, []
        for found in batches:
            for i in range(0, found.num_rows, 1000):
                part = found.slice(i, 1000)
                for head, depth, before, size, above, suffix, after, low, *sums in zip(*(part.column(n).to_pylist() for n in names), strict=True):
                    if container is None or container.head != head:
                        out += container.rows() if container else ()
                        container = _Container(head, depth, before, size, above)
                    container.add(suffix, after, low, tuple(sums))
                if len(out) > 5000:
                    yield batch(out)
                    out = []
        out += container.rows() if container else ()
        if out:
            yield batch(out)

    return items.select(*names).repartition("head").sortWithinPartitions("head", "suffix", "next").mapInArrow(run, NODE)


def _nodes(suffixes: DataFrame) -> DataFrame:
    """All nodes. The head of a later suffix gets its parent and its text's bytes from the container above."""
    small, burst = _burst(_folded(suffixes))
    swept = _swept(small)
    found = written(swept if burst is None else swept.unionByName(burst), "nodes")
    stubs = found.where("stub IS NOT NULL").select(F.col("stub").alias("_joint"), F.col("above").alias("_above"), F.col("bytes").alias("_bytes"))
    met = found.where("joint IS NOT NULL").drop("above", "bytes").join(stubs, F.col("joint") == F.col("_joint"))
    plain = found.where("joint IS NULL AND stub IS NULL")
    return plain.unionByName(met.withColumnsRenamed({"_above": "above", "_bytes": "bytes"}).select(*found.columns))


# --- conversations that end at a node ---------------------------------------------------------------------------------


def _ends(sequences: DataFrame) -> DataFrame:
    """(_ending, ends): the smallest conversation of each sequence and the hash of all its conversations' ids.

    Ids are joined into texts of at most 4,096 by ranges of (sequence, id); one task then hashes a sequence's texts in
    order, as SHA-256 runs in order by definition, and holds one of them at a time.
    """

    def joined(batches):
        for found in batches:
            seqs, ids = found.column("seq").to_pylist(), found.column("conv_id").to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if seqs[i] != seqs[i - 1]), len(ids)]
            spans = [(i, min(i + 4096, b)) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, 4096)]
            yield pa.RecordBatch.from_pydict({"seq": pa.array([seqs[a] for a, _ in spans], pa.string()), "first": pa.array([ids[a] for a, _ in spans], pa.int64()), "ids": pa.array([",".join(map(str, ids[a:b])) for a, b in spans], pa.string())})

    def hashed(batches):
        now, low, state = None, None, None
        for found in batches:
            out = []
            for seq, first, ids in zip(*(found.column(n).to_pylist() for n in ("seq", "first", "ids")), strict=True):
                if seq == now:
                    state.update(b"," + ids.encode())
                    continue
                if state is not None:
                    out.append((low, state.hexdigest()))
                now, low, state = seq, first, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pydict({"_ending": pa.array([r[0] for r in out], pa.int64()), "ends": pa.array([r[1] for r in out], pa.string())})
        if state is not None:
            yield pa.RecordBatch.from_pydict({"_ending": pa.array([low], pa.int64()), "ends": pa.array([state.hexdigest()], pa.string())})

    pieces = sequences.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id").mapInArrow(joined, "seq string, first long, ids string")
    return pieces.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashed, "_ending long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node."""
    segments = written(_segments(conversations), "segments")
    sequences = written(_sequences(segments), "sequences")
    suffixes = written(_suffixes(segments, sequences), "suffixes")
    zero = F.lit(0).cast("long")
    first = _nodes(suffixes.withColumns({"own": zero, "leaf": zero}))
    owned = first.groupBy(F.col("conv_id").alias("_c")).agg(F.sum("bytes").alias("own"), F.max((F.col("children") == 0).cast("long")).alias("leaf"))
    known = suffixes.join(owned, F.col("conv_id") == F.col("_c"), "left").drop("_c").fillna(0, ["own", "leaf"])
    nodes = _nodes(known)
    saved = F.col("w") - (F.col("n") - 1) * (F.col("before") - F.col("bytes")) - F.col("own") + F.col("low_own") - F.col("low_total")
    met = nodes.join(_ends(sequences), F.col("ending") == F.col("_ending"), "left")
    return met.select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaf").alias("n_leaves"),
        saved.alias("saved_tokens"), F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
