"""The prefix trie of conversations, merged family by family first.

A family is the conversations whose ids have one base id (id - id % FAMILY). The base conversation's rows
are cogrouped with those of the others; a task rebuilds each conversation of a family (the first h turns of
the base, then its own after its first h) and builds the family's small trie. Only the combined nodes of
the families are shuffled and merged by node; sums over subtrees go back to the families in the same
way: a node's figure is put into the one family that owns it (that of its smallest member), each family adds up
its own subtrees, and the families' sums are added by node. So no step walks the depth of the trie.

A node's key adds up one 128-bit hash for each turn, of its place and content, in four lanes, so the key of a
long conversation can be summed in parts. Texts are hashed and their words counted where they are read; none is
shuffled.

Hot keys: a conversation of over ``LONG`` turns is no family's: its rows are ordered over partitions, and running counts
and sums are taken in each partition and carried over by the partitions' totals. It is merged as a
chain of its own. Hot nodes (the root, a first turn that all share) are partial sums before they are shuffled; parents of
many children are broadcast. Ids at a node's end are gathered in blocks of ``BLOCK`` consecutive ids and hashed as
a stream in the order of blocks.

Defined cases: null turns come first; of equal turns of a conversation, the order is that of the MD5 of role and text;
a null role or text is empty; rows without conversation id belong to no conversation; a conversation that its h
leaves without turns is a member of the root alone; repeated rows are turns of their own; other columns are not
looked at; an empty table has no nodes, not even a root. Texts may be of any length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.arrow import as_long, batch, bounded, look_up, saved, small

FAMILY = 20
#: A conversation shares crc32(id) % SHARED turns with its base.
SHARED = 4
LONG = 20_000
BLOCK = 1 << 16
BROADCAST_ROWS = 1_000_000
WORD = r"[^\x20\x09-\x0D]+"
ROOT = bytes(16)

_NODES = pa.schema([("family", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()), ("words", pa.int64()), ("ends", pa.list_(pa.int64()))])
NODES = "family long, node binary, parent binary, depth long, n long, conv long, words long, ends array<long>"
_SUMS = pa.schema([("node", pa.binary()), ("leaves", pa.int64()), ("saved", pa.int64())])
SUMS = "node binary, leaves long, saved long"


def shared_turns(conv: int) -> int:
    return zlib.crc32(str(conv).encode()) % SHARED


def turn_rows(conversations: DataFrame, id_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(conv, family, turn, content, words): content is the MD5 of role and text."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_column, text_column))
    content = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    words = F.regexp_count(text, F.lit(WORD))
    rows = bounded(conversations).select(as_long(conversations, id_column).alias("conv"), as_long(conversations, turn_column).alias("turn"), content.alias("content"), words.cast("long").alias("words"))
    return rows.where("conv is not null").withColumn("family", F.col("conv") - F.col("conv") % FAMILY)


def turn_hash(place: int, content: str) -> bytes:
    return hashlib.md5(f"{place}:{content}".encode()).digest()


def prefixes(contents: list[str]) -> list[bytes]:
    """The keys of a conversation's prefixes of 1, 2, ... turns."""
    if not contents:
        return []
    lanes = np.frombuffer(b"".join(turn_hash(k + 1, c) for k, c in enumerate(contents)), ">u4").reshape(-1, 4)
    return [x.tobytes() for x in np.cumsum(lanes, axis=0, dtype=np.uint32).astype(">u4")]


def family_trie(base: pa.Table, others: pa.Table) -> pa.Table:
    """The trie of a family. ``base``: (conv, turn, content, words, member), in which the rows of a long base are the
    first turns alone and no members."""
    order = [("conv", "ascending"), ("turn", "ascending"), ("content", "ascending")]
    family = (base if base.num_rows else others).column("family")[0].as_py()
    head: list[tuple[str, int]] = []
    talks: list[tuple[int, list[tuple[str, int]]]] = []
    for table, is_base in ((base, True), (others, False)):
        if not table.num_rows:
            continue
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        convs = table.column("conv").to_numpy()
        turns = list(zip(table.column("content").to_pylist(), table.column("words").to_pylist()))
        bounds = [0, *(np.flatnonzero(convs[1:] != convs[:-1]) + 1).tolist(), len(convs)]
        if is_base:
            head = turns[: SHARED - 1]
        if not is_base or table.column("member")[0].as_py():
            talks += [(int(convs[a]), turns[a:b]) for a, b in zip(bounds, bounds[1:])]
    nodes: dict[bytes, list] = {}
    for conv, own in sorted(talks, key=lambda t: t[0]):
        h = shared_turns(conv)
        built = head[:h] + own[h:]
        keys = [ROOT, *prefixes([c for c, _ in built])]
        for depth, key in enumerate(keys):
            if key in nodes:
                nodes[key][3] += 1
            else:
                nodes[key] = [key, keys[depth - 1] if depth else None, depth, 1, conv, built[depth - 1][1] if depth else 0, []]
        nodes[keys[-1]][6].append(conv)
    columns = list(zip(*nodes.values())) or [[]] * 7
    return pa.Table.from_batches([batch(_NODES, [family] * len(nodes), *columns)])


def family_sums(nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """For every node of a family, the sums over its subtree of what the family's own nodes hold."""
    sums = {k: [0, 0] for k in nodes.column("node").to_pylist()}
    for key, leaf, value in zip(*(owned.column(c).to_pylist() for c in ("node", "leaf", "value"))):
        sums[key] = [leaf, value]
    rows = sorted(zip(nodes.column("depth").to_pylist(), nodes.column("node").to_pylist(), nodes.column("parent").to_pylist()), reverse=True, key=lambda r: r[0])
    for _, key, parent in rows:
        if parent is not None:
            sums[parent][0] += sums[key][0]
            sums[parent][1] += sums[key][1]
    return pa.Table.from_batches([batch(_SUMS, list(sums), [x for x, _ in sums.values()], [x for _, x in sums.values()])])


def _near(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if small(df, rows) else df


def running(rows: DataFrame, order: str, sums: list[str]) -> DataFrame:
    """Running sums of each conversation's rows, this row included, as ``run_<name>``: within partitions (column
    ``part``, whose numbers follow the order), then carried over by the partitions' totals."""
    totals = rows.groupBy("conv", "part").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv", "part", *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"off_{c}") for c in sums])
    within = Window.partitionBy("conv", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.select("*", *[F.sum(c).over(within).alias(f"in_{c}") for c in sums]).join(_near(offsets), ["conv", "part"])
    return summed.select(*rows.columns, *[(F.col(f"in_{c}") + F.col(f"off_{c}")).alias(f"run_{c}") for c in sums])


def ranked(rows: DataFrame) -> DataFrame:
    """The rows of long conversations with their partition and rank. Equal rows are dealt over partitions by a last, free key."""
    keys = ["conv", F.col("turn").asc_nulls_first(), "content", "free"]
    dealt = rows.withColumn("free", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    part, pos = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")
    stored = saved(dealt.select("conv", "family", "content", "words", part, pos, F.lit(1).cast("long").alias("one")), "long-turns")
    return running(stored, "pos", ["one"]).withColumnRenamed("run_one", "rank")


def chains(long: DataFrame, heads: DataFrame) -> DataFrame:
    """The nodes of long conversations, one row a turn and one for the root: (conv, part, node, parent, depth, words, last).
    ``heads``: (family, rank, content, words) of the first turns of base conversations."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    count = heads.groupBy("family").agg(F.count("*").alias("heads"))
    convs = long.groupBy("conv", "family").agg(F.max("rank").alias("turns")).join(count, "family", "left").withColumn("h", h).withColumn("kept", F.least("h", F.coalesce("heads", F.lit(0))))
    own = long.join(_near(convs.select("conv", "h", "kept")), "conv").where("rank > h").select("conv", "part", (F.col("rank") - F.col("h") + F.col("kept")).alias("depth"), "content", "words")
    first = convs.join(heads, "family").where("rank <= h").select("conv", F.lit(-1).alias("part"), F.col("rank").alias("depth"), "content", "words")
    rows = own.unionByName(first)
    digest = F.md5(F.concat(F.col("depth").cast("string"), F.lit(":"), "content").cast("binary"))
    lanes = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"lane{k}") for k in range(4)]
    summed = running(rows.select("*", *lanes), "depth", [f"lane{k}" for k in range(4)])
    word = lambda value: F.lpad(F.hex(F.pmod(value, F.lit(1 << 32))), 8, "0")
    key = F.unhex(F.concat(*[word(F.col(f"run_lane{k}")) for k in range(4)]))
    before = F.unhex(F.concat(*[word(F.col(f"run_lane{k}") - F.col(f"lane{k}")) for k in range(4)]))
    length = convs.select("conv", (F.greatest(F.col("turns") - F.col("h"), F.lit(0)) + F.col("kept")).alias("length"))
    nodes = summed.select("conv", "part", key.alias("node"), F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(before).alias("parent"), "depth", "words")
    roots = convs.select("conv", F.lit(-2).alias("part"), F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"))
    return nodes.unionByName(roots).join(_near(length), "conv").withColumn("last", F.col("depth") == F.col("length")).drop("length")


_DIGESTS = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])


def ends_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the blocks of each node, which follow each other in order."""
    node, state = None, None
    for rows in batches:
        out = []
        for key, ids in zip(rows.column(0).to_pylist(), rows.column(1)):
            if key != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
                state.update(ids.as_py().encode())
            else:
                state.update(b"," + ids.as_py().encode())
        if out:
            yield batch(_DIGESTS, *zip(*out))
    if state is not None:
        yield batch(_DIGESTS, [node], [state.hexdigest()])


def prefix_trie(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", long: int = LONG) -> DataFrame:
    """One row a node: (node, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); ``node``
    is its key."""
    rows = turn_rows(conversations, id_column, turn_column, role_column, text_column)
    sizes = rows.groupBy("conv").count().where(F.col("count") > long).select("conv")
    long_ids = saved(sizes, "long-ids")
    chain = None
    if long_ids.limit(1).count():
        near = _near(long_ids)
        placed = ranked(rows.join(near, "conv", "left_semi"))
        rows = rows.join(near, "conv", "left_anti")
        families = _near(placed.select("family").distinct())
        first = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "content")
        of_others = rows.where("conv = family").join(families, "family", "left_semi").withColumn("rank", F.row_number().over(first).cast("long"))
        heads = placed.where("conv = family").select("family", "rank", "content", "words").unionByName(of_others.select("family", "rank", "content", "words")).where(F.col("rank") < SHARED)
        heads = saved(heads, "heads")
        chain = saved(chains(placed, heads), "chains")
        long_heads = heads.join(near.withColumnRenamed("conv", "family"), "family", "left_semi")
        given = long_heads.select(F.col("family").alias("conv"), F.col("rank").alias("turn"), "content", "words", "family", F.lit(False).alias("member"))
    columns = ["conv", "turn", "content", "words", "family"]
    base = rows.where("conv = family").select(*columns, F.lit(True).alias("member"))
    if chain is not None:
        base = base.unionByName(given)
    others = rows.where("conv <> family").select(*columns)
    base = base.select([F.col(c).alias(c) for c in base.columns])  # not the columns of the other side
    nodes = saved(base.groupBy("family").cogroup(others.groupBy("family")).applyInArrow(family_trie, NODES), "family-nodes")

    parts = nodes.select("node", "parent", "depth", "n", "conv", "words")
    ends = nodes.select("node", F.explode("ends").alias("id"))
    if chain is not None:
        parts = parts.unionByName(chain.select("node", "parent", "depth", F.lit(1).cast("long").alias("n"), "conv", "words"))
        ends = ends.unionByName(chain.where("last").select("node", F.col("conv").alias("id")))
    merged = parts.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("words").alias("words"))
    merged = saved(merged, "nodes")
    children = merged.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_children"))
    whole = merged.join(children.withColumnRenamed("parent", "node"), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    whole = saved(whole, "nodes-with-children")
    parents = whole.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = look_up(whole.where("parent is not null").select("node", "parent"), parents, ["parent"], "n_children").select("node", "parent_conv_id")

    values = whole.select("node", F.col("conv_id").alias("conv"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("value"))
    of_families = values if chain is None else values.join(near, "conv", "left_anti")
    of_families = of_families.withColumn("family", F.col("conv") - F.col("conv") % FAMILY).select("family", "node", "leaf", "value")
    sums = nodes.select("family", "node", "parent", "depth").groupBy("family").cogroup(of_families.groupBy("family")).applyInArrow(family_sums, SUMS)
    if chain is not None:
        mine = chain.select("conv", "part", "node", "depth").join(values, ["conv", "node"], "left").fillna(0, ["leaf", "value"])
        mine = running(mine, "depth", ["leaf", "value"])
        total = mine.groupBy("conv").agg(F.sum("leaf").alias("all_leaf"), F.sum("value").alias("all_value"))
        below = mine.join(_near(total), "conv").select("node", (F.col("all_leaf") - F.col("run_leaf") + F.col("leaf")).alias("leaves"), (F.col("all_value") - F.col("run_value") + F.col("value")).alias("saved"))
        sums = sums.unionByName(below)
    sums = sums.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    blocks = ends.groupBy("node", F.floor(F.col("id") / BLOCK).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"))
    digests = blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(ends_digest, "node binary, ends_sha256 string")
    out = whole.join(sums, "node").join(named, "node", "left").join(digests, "node", "left")
    return out.select("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
