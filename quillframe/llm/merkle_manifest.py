"""Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

A leaf hashes a row's named columns; the leaves of a group (a language) stand in the order of their id. A leaf's place is
the rank of its id among the group's ids, and the ranks need no sort of the leaves:

* The ids of a group make a compressed bitmap: 64-bit words, of which only those that are not zero are rows. They are
  merged by ``bit_or``, partially before the shuffle.
* A popcount directory holds for each word how many leaves stand before it. It is a tree of 512 children a node, so no
  window sees more than :data:`ROOT_ROWS` words, however sparse the ids are.
* A leaf's place is its word's count plus the bits below its own. Words whose ids repeat (more rows than bits) number
  their rows in two levels instead, so one id may hold most rows.

Leaves go by place into keyed arrays of 512 slots, three levels of the tree in one row. The arrays are reduced level by
level to the groups' roots and these, in their groups' order, to the root; then the sibling paths go down from the root,
so that each leaf's proof is made where its array lies.

A null id comes first and has no other reading; rows of one id stand by their leaves, and equal rows have the same leaf
and one place each. Null columns count as ``-``. Null is a group of its own and comes first. One group has its own root as
the root, and a lone leaf is its group's root. An empty table gives an empty table. Only the columns named to
:func:`manifest` are read, so further ones of any name do no harm.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillframe.llm.storage import lookup, written
from quillframe.operators.planning import numbered, sums_before

FAN = 8
LEVELS = 3
SLOTS = FAN**LEVELS
#: Words of a group up to which one window numbers them; larger directories get another level.
ROOT_ROWS = 4096

PATH = "array<struct<before: string, after: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The hash of a row's columns: ``-`` for null, else the UTF-8 bytes' number, a colon and the value."""
    shown = (c.cast("string") for c in columns)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in shown)), 256)


def _window(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("word").rowsBetween(Window.unboundedPreceding, -1)


def directory(words: DataFrame) -> DataFrame:
    """(grp, word, n) with ``before``, the sum of n over the group's smaller words."""
    largest = words.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    if largest <= ROOT_ROWS:
        return words.withColumn("before", F.coalesce(F.sum("n").over(_window("grp")), F.lit(0)))
    upper = written(words.groupBy("grp", F.shiftright("word", 9).alias("word")).agg(F.sum("n").alias("n")), "directory")
    above = directory(upper).select(F.col("grp").alias("_g"), F.col("word").alias("_w"), F.col("before").alias("_before"))
    inner = words.withColumn("_up", F.shiftright("word", 9)).withColumn("_in", F.coalesce(F.sum("n").over(_window("grp", "_up")), F.lit(0)))
    joined = inner.join(above, (F.col("grp") == F.col("_g")) & (F.col("_up") == F.col("_w")))
    return joined.select(*words.columns, (F.col("_in") + F.col("_before")).alias("before"))


def coordinates(leaves: DataFrame) -> DataFrame:
    """leaves (grp, id, leaf, other; a written table) with ``place`` from 0 in the group, by id (null first) and leaf."""
    bit = F.coalesce(F.col("id").bitwiseAND(63), F.lit(0)).cast("int")
    word = F.coalesce(F.shiftright("id", 6), F.lit(-(2**57) - 1))
    keyed = leaves.withColumns({"word": word, "_bit": bit})
    merged = keyed.groupBy("grp", "word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("bits"), F.count("*").alias("n"))
    words = written(merged, "bitmap")
    ranks = written(directory(words), "ranks").withColumnsRenamed({"grp": "_g", "word": "_w"})
    found = keyed.join(lookup(ranks), (F.col("grp") == F.col("_g")) & (F.col("word") == F.col("_w")))
    single = F.bit_count("bits") == F.col("n")
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, _bit)")).cast("long")
    placed = found.where(single).select(*leaves.columns, (F.col("before") + below).alias("place"))
    if words.where(~single).isEmpty():
        return placed
    several = found.where(~single).select(*leaves.columns, "word", "before")
    counted = sums_before(several, ["grp", "word"], ["id", "leaf"], _nth=F.lit(1))
    return placed.unionByName(counted.select(*leaves.columns, (F.col("before") + F.col("_nth")).alias("place")))


def _slotted(rows: DataFrame, **held: str) -> DataFrame:
    """rows (grp, place, n) as (grp, block, n, slots): keyed arrays of at most SLOTS rows."""
    slot = F.struct((F.col("place") % SLOTS).cast("int").alias("slot"), *(F.col(c).alias(n) for n, c in held.items()))
    cut = F.floor(F.col("place") / SLOTS).cast("long")
    return rows.groupBy("grp", cut.alias("block"), "n").agg(F.sort_array(F.collect_list(slot)).alias("slots"))


def levels(hashes: list[str], whole: bool) -> list[list[str]]:
    """The levels over an array's hashes: three, or, if the array is its whole group, as many as lead to one node."""
    out = [hashes]
    while (len(out[-1]) > 1) if whole else (len(out) <= LEVELS):
        last = out[-1]
        out.append([digest("".join(last[i : i + FAN])) for i in range(0, len(last), FAN)])
    return out


def steps(tree: list[list[str]], at: int) -> list[tuple[str, str]]:
    """What stands before and after the node on the way up from slot ``at``, level by level."""
    out = []
    for level in tree[:-1]:
        first = at - at % FAN
        out.append(("".join(level[first:at]), "".join(level[at + 1 : first + FAN])))
        at //= FAN
    return out


def _arrow(make, columns: list[str], schema: str):
    """Runs make(row) -> rows over the rows of a batch; a row comes as the values of columns."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):  # few arrays as Python values at a time
                part = batch.slice(i, 64)
                rows = [r for row in zip(*(part.column(c).to_pylist() for c in columns), strict=True) for r in make(*row)]
                yield pa.RecordBatch.from_pylist([dict(zip(target.names, r, strict=True)) for r in rows], schema=target)

    return run


def _reduced(blocks: DataFrame) -> DataFrame:
    """(grp, place, n, hash, whole): each array's top node; n counts the nodes of the group at that level."""

    def top(grp, block, n, slots):
        yield grp, block, -(-n // SLOTS), levels([s["hash"].hex() for s in slots], n <= SLOTS)[-1][0], n <= SLOTS

    schema = "grp string, place long, n long, hash string, whole boolean"
    return blocks.mapInArrow(_arrow(top, ["grp", "block", "n", "slots"], schema), schema)


def _paths(blocks: DataFrame) -> DataFrame:
    """(grp, place, whole, path) of each slot's node; ``path`` of an array leads from its top node to the root. A slot with
    a key is the top node of that group."""

    def below(grp, block, n, slots, path):
        tree = levels([s["hash"].hex() for s in slots], n <= SLOTS)
        for s in slots:
            own = [{"before": a, "after": b} for a, b in steps(tree, s["slot"])]
            if s["key"] is None:
                yield grp, block * SLOTS + s["slot"], False, own + path
            else:
                yield s["key"], 0, True, own + path

    schema = f"grp string, place long, whole boolean, path {PATH}"
    return blocks.mapInArrow(_arrow(below, ["grp", "block", "n", "slots", "path"], schema), schema)


def _proved(blocks: DataFrame) -> DataFrame:
    """The proofs of each array's leaves."""

    def proofs(slots, n, path, subroot, root):
        tree = levels([s["leaf"].hex() for s in slots], n <= SLOTS)
        upper = [(p["before"], p["after"]) for p in path]
        tail = "".join(a + b for a, b in upper)
        for s in slots:
            own = steps(tree, s["slot"])
            folded = (s["other"] or s["leaf"]).hex()
            for a, b in [*own, *upper]:
                folded = digest(a + folded + b)
            yield s["id"], s["leaf"].hex(), subroot, root, digest("".join(a + b for a, b in own) + tail), folded, folded == root

    schema = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.mapInArrow(_arrow(proofs, ["slots", "n", "path", "subroot", "root"], schema), schema)


def _tree(nodes: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of arrays over nodes (grp, place, n, hash, key), the lowest first, and the groups' top nodes."""
    tables, tops = [], None
    while True:
        blocks = written(_slotted(nodes, hash="hash", key="key"), "arrays")
        tables.append(blocks)
        upper = written(_reduced(blocks), "nodes")
        done = upper.where("whole").select("grp", "hash")
        tops = done if tops is None else tops.unionByName(done)
        most = -(-most // SLOTS)
        if most <= 1:
            return tables, tops
        nodes = upper.where("NOT whole").select("grp", "place", "n", F.unhex("hash").alias("hash"), F.lit(None).cast("string").alias("key"))


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """Arrays with the path of their top node; that of a whole group's array is its group's."""
    known = paths.select(F.col("grp").alias("_g"), F.col("place").alias("_p"), F.col("whole").alias("_w"), "path")
    whole = F.col("n") <= SLOTS
    return blocks.join(known, (F.col("grp") == F.col("_g")) & (F.col("block") == F.col("_p")) & (whole == F.col("_w")))


def _down(tables: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths of the nodes in the lowest arrays, from the paths of the groups' top nodes."""
    paths = tops
    for blocks in reversed(tables):
        below = _paths(_with_paths(blocks, paths))
        paths = below if blocks is tables[0] else below.unionByName(tops)
    return paths


def manifest(docs: DataFrame, *, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row.

    ``changed`` gives columns other values in the rows ``where`` holds; the root is folded anew from such a row's changed
    leaf and the original siblings, and is verified if it is the root still.
    """
    named = [F.col(f"`{c}`") for c in columns]
    own = F.unhex(leaf(*named))
    other = F.lit(None).cast("binary")
    if changed:
        other = F.when(where, F.unhex(leaf(*(changed.get(c, F.col(f"`{c}`")) for c in columns))))
    grp = F.coalesce(F.concat(F.lit("+"), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = written(docs.select(grp.alias("grp"), F.col(f"`{key}`").cast("long").alias("id"), own.alias("leaf"), other.alias("other")), "leaves")
    counts = written(leaves.groupBy("grp").agg(F.count("*").alias("n")), "groups")
    most = counts.agg(F.max("n"), F.count("*")).first()
    sized = counts.withColumnsRenamed({"grp": "_group"})
    placed = coordinates(leaves).join(F.broadcast(sized) if most[1] <= SLOTS else sized, F.col("grp") == F.col("_group"))
    lowest = written(_slotted(placed, id="id", leaf="leaf", other="other"), "leaf-arrays")
    plain = lowest.withColumn("slots", F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), s["leaf"].alias("hash"), F.lit(None).cast("string").alias("key"))))
    upper = written(_reduced(plain), "nodes")
    subroots = upper.where("whole").select("grp", "hash")
    tables = []
    if (most[0] or 0) > SLOTS:
        rest = upper.where("NOT whole").select("grp", "place", "n", F.unhex("hash").alias("hash"), F.lit(None).cast("string").alias("key"))
        tables, tops = _tree(rest, -(-most[0] // SLOTS))
        subroots = subroots.unionByName(tops)
    subroots = written(subroots, "subroots")
    ordered = numbered(subroots, "nth", "grp")
    heads = ordered.select(F.lit("").alias("grp"), (F.col("nth") - 1).alias("place"), F.lit(most[1]).cast("long").alias("n"), F.unhex("hash").alias("hash"), F.col("grp").alias("key"))
    above, tops = _tree(heads, most[1] or 1)
    root = (tops.first() or [None, None])[1]
    start = tops.select("grp", F.lit(0).cast("long").alias("place"), F.lit(True).alias("whole"), F.expr(f"CAST(array() AS {PATH})").alias("path"))
    paths = written(_down(above, start), "paths")
    if tables:
        paths = _down(tables, paths).unionByName(paths)
    ends = subroots.select(F.col("grp").alias("_top"), F.col("hash").alias("subroot"))
    joined = _with_paths(lowest, paths).join(F.broadcast(ends) if most[1] <= SLOTS else ends, F.col("grp") == F.col("_top"))
    return _proved(joined.withColumn("root", F.lit(root).cast("string")))
