"""The trie of shared conversation prefixes, by partition refinement.

All conversations begin in one class, the root. Round d splits the classes that are still active by their members' d-th turn;
every piece is a node. A piece of one conversation is retired: what is left of it is a chain without branches and is emitted
as such at once. When no class is active, the nodes are folded back from the deepest level to the root: children are counted,
leaves and saved code points are summed over subtrees.

Conversations that are equal turn by turn are one weighted member before the first round, so copies neither keep a class
active nor make it hot, and there are as many rounds as the longest prefix that two *different* conversations share, plus one.

Scale: a turn is a SHA-256 digest and its code points once the texts are read. Members carry ``BLOCK`` turns at a time, so a
round reads its active members only and the next block is joined when it begins; a retired conversation is joined with its
turns once. Pieces are counted with map-side combine and written; members meet them in a join of two written tables, which
adaptive execution splits where a piece is hot (a first turn that a third of all conversations share). Conversations of more
than ``LONG`` turns are numbered and summed in parts. Ends of a node are concatenated in spans of ``SPAN`` ids, a bounded group;
nodes with several spans are hashed by streaming these through one task, which holds one span.

Defined results: turns are in order of turn, null first, equal turns by digest; null role or text is empty; repeated
rows are turns each; rows without conv_id are no conversation; an empty table has no root and no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmill.operators.tables import running_sum

from .common import materialize, release_memory

BLOCK, LONG, SPAN = 8, 50_000, 8192


def _summed(df: DataFrame, by: str, order: list[Column], value: Column, out: str, long: int) -> DataFrame:
    """``df`` with the sum of ``value`` up to its row in its ``by`` group; groups of more than ``long`` rows in parts."""
    large = df.groupBy(by).count().where(F.col("count") > long).select(by)
    upto = F.sum(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    if large.isEmpty():
        return df.withColumn(out, upto)
    hot = running_sum(df.join(large, by, "left_semi"), [by], order, value, out).withColumn(out, F.col(out) + value)
    return df.join(large, by, "left_anti").withColumn(out, upto).unionByName(hot)


def turns_of(rows: DataFrame, long: int = LONG) -> DataFrame:
    """(conv_id, place from 1, key, points): every turn's digest and the code points of its text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    bare = rows.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.length(text).cast("long").alias("points"))
    order = [F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), F.col("key")]
    numbered = _summed(materialize(bare, "trie-read"), "conv_id", order, F.lit(1).cast("long"), "place", long)
    return materialize(numbered.select("conv_id", "place", "key", "points"), "trie-turns")


def heads(conv: Column) -> Column:
    """How many turns a conversation has from the first one of its hundred."""
    return (F.crc32(conv.cast("string").cast("binary")) % 6).cast("int")


def rebuilt(turns: DataFrame, leader: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns) with the first ``head`` turns of ``leader`` in place of as many of their own."""
    own = materialize(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"leader": leader, "h": head.cast("long")}), "trie-convs")
    lead = own.select(F.col("conv_id").alias("leader"), F.col("n").alias("_n"))
    convs = own.join(lead, "leader", "left").withColumn("m", F.least("h", F.coalesce("_n", F.lit(0))))
    convs = materialize(convs.select("conv_id", "leader", "h", "m"), "trie-plan")
    kept = turns.join(convs, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("m")).alias("place"), "key", "points")
    wanted = convs.where("m > 0").select("conv_id", F.col("leader").alias("_leader"), F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("place"))
    first = turns.select(F.col("conv_id").alias("_leader"), "place", "key", "points")
    taken = wanted.join(first, ["_leader", "place"]).select("conv_id", "place", "key", "points")
    return convs.select("conv_id"), materialize(kept.unionByName(taken), "trie-rebuilt")


def members_of(convs: DataFrame, turns: DataFrame, span: int = SPAN) -> DataFrame:
    """(rep, weight, len, ends_sha256) of each set of equal conversations; rep is the smallest conv_id.

    Sets are told by their length and two 64-bit sums over the digests of their turns and places, which needs no order.
    """
    same = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("len"), F.sum(F.xxhash64("place", "key").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("key", "place", F.lit("x"))).alias("b")
    )
    kind = ["len", "a", "b"]
    known = convs.join(same, "conv_id", "left").withColumns({"len": F.coalesce("len", F.lit(0)), "a": F.coalesce("a", F.lit(0).cast("decimal(38,0)")), "b": F.coalesce("b", F.lit(0))})
    known = materialize(known, "trie-kinds")
    sets = known.groupBy(*kind).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    node = F.concat_ws(":", *[F.col(c).cast("string") for c in kind])
    ends = materialize(ends_digest(known.select("conv_id", node.alias("node")), span), "trie-ends")
    sets = materialize(sets.withColumn("node", node), "trie-groups")
    return materialize(sets.join(ends, "node").select("rep", "weight", "len", "ends_sha256"), "trie-sets")


def ends_digest(ends: DataFrame, span: int = SPAN) -> DataFrame:
    """SHA-256 of the comma-joined conv_ids of each ``node``, in ascending order."""
    spans = ends.groupBy("node", F.floor(F.col("conv_id") / span).alias("span")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    spans = materialize(spans, "trie-spans")
    few = spans.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("ids").alias("ids"))
    single = few.where("n = 1").select("node", F.sha2("ids", 256).alias("ends_sha256"))
    many = spans.join(few.where("n > 1").select("node"), "node", "left_semi")
    dealt = many.repartition("node").sortWithinPartitions("node", "span")

    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist())

        for node, group in itertools.groupby(rows(), key=lambda r: r[0]):
            digest = hashlib.sha256()
            for i, (_, ids) in enumerate(group):
                digest.update(("," if i else "").encode() + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])
        release_memory()

    return single.unionByName(dealt.select("node", "ids").mapInArrow(run, "node string, ends_sha256 string"))


def refine(sets: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes by depth (conv_id, parent, n_convs, reps, points, rest, end) and the retired members (rep, depth).

    ``rest`` is the number of members that go on, ``end`` the one that has no further turn.
    """
    block = F.floor((F.col("place") - 1) / BLOCK)
    blocks = turns.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "key", "points"))).alias("turns"))
    blocks = materialize(blocks.withColumnRenamed("conv_id", "rep"), "trie-blocks")
    spread = {"n_convs": F.sum("weight"), "reps": F.count(F.lit(1)), "points": F.max("points"), "rest": F.sum((F.col("len") > F.col("depth")).cast("long")), "end": F.max(F.when(F.col("len") == F.col("depth"), F.col("rep")))}
    at = lambda d: sets.withColumns({"depth": F.lit(d), "points": F.lit(0).cast("long")})
    root = materialize(at(0).agg(F.min("rep").alias("conv_id"), *[v.alias(k) for k, v in spread.items()]).where("reps > 0").withColumn("parent", F.lit(None).cast("long")), "trie-node")
    levels, retired = [root], []
    first = root.first()
    if first is None:
        return [], sets.select("rep", F.lit(0).alias("depth")).limit(0)
    active = sets.select("rep", "weight", "len", F.lit(first["conv_id"]).alias("class")).where("len > 0")
    if first["reps"] == 1:
        return levels, sets.select("rep", F.lit(0).alias("depth"))
    depth = 0
    while True:
        if depth % BLOCK == 0:
            # Members that go on have a turn in the next block.
            active = materialize(active.join(blocks.where(F.col("block") == depth // BLOCK).drop("block"), "rep"), "trie-active")
        depth += 1
        turn = F.element_at("turns", (depth - 1) % BLOCK + 1)
        now = active.where(F.col("len") >= depth).select("rep", "weight", "len", "turns", "class", turn["key"].alias("key"), turn["points"].alias("points"), F.lit(depth).alias("depth"))
        pieces = now.groupBy("class", "key").agg(F.min("rep").alias("conv_id"), *[v.alias(k) for k, v in spread.items()])
        pieces = materialize(pieces, "trie-node")
        told = pieces.agg(F.count(F.lit(1)), F.max(F.when(F.col("reps") > 1, F.col("rest")))).first()
        if not told[0]:
            break
        levels.append(pieces.withColumnRenamed("class", "parent").drop("key"))
        retired.append(pieces.where("reps = 1 and rest = 1").select(F.col("conv_id").alias("rep"), F.lit(depth).alias("depth")))
        if not told[1]:
            break
        going = pieces.where("reps > 1 and rest > 0").select("class", "key", F.col("conv_id").alias("_next"))
        active = materialize(now.where(F.col("len") > depth).join(going, ["class", "key"]).select("rep", "weight", "len", "turns", F.col("_next").alias("class")).drop(*["turns"] * (depth % BLOCK == 0)), "trie-active")
    out = sets.select("rep", F.lit(0).alias("depth")).limit(0)
    for r in retired:
        out = out.unionByName(r)
    return levels, materialize(out, "trie-retired")


def fold_back(levels: list[DataFrame], tails: DataFrame) -> DataFrame:
    """The refined nodes with their children, leaves and saved code points; ``tails`` has (rep, below) of retired members."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        nodes = levels[depth].withColumn("depth", F.lit(depth).cast("long"))
        own = (F.col("n_convs") - 1) * F.col("points")
        single = nodes.where("reps = 1").join(tails.withColumnRenamed("rep", "conv_id"), "conv_id", "left")
        single = single.select(*nodes.columns, (F.col("rest") > 0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), (own + F.coalesce("below", F.lit(0))).alias("saved_tokens"))
        inner = nodes.where("reps > 1")
        if below is None:
            inner = inner.withColumns({"_c": F.lit(None).cast("long"), "_l": F.lit(None).cast("long"), "_s": F.lit(None).cast("long")})
        else:
            inner = inner.join(below, "conv_id", "left")
        inner = inner.select(*nodes.columns, F.coalesce("_c", F.lit(0)).alias("n_children"), F.coalesce("_l", F.lit(1)).alias("n_leaves"), (own + F.coalesce("_s", F.lit(0))).alias("saved_tokens"))
        folded = materialize(single.unionByName(inner), "trie-folded")
        below = folded.groupBy(F.col("parent").alias("conv_id")).agg(F.count(F.lit(1)).alias("_c"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        out.append(folded)
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every


def prefix_trie(conversations: DataFrame, leader: Column | None = None, head: Column | None = None, long: int = LONG, span: int = SPAN) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    ``leader`` and ``head``, columns over conv_id, name the conversation whose first turns replace as many of one's own; by
    default the first one of each hundred and a checksum of the id.
    """
    c = F.col("conv_id")
    convs, turns = rebuilt(turns_of(conversations, long), c - c % 100 if leader is None else leader, heads(c) if head is None else head)
    sets = members_of(convs, turns, span)
    alone = turns.join(sets.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi")
    alone = materialize(_summed(alone, "conv_id", [F.col("place")], F.col("points"), "upto", long), "trie-distinct")
    levels, retired = refine(sets, alone)
    if not levels:
        return sets.select(*[F.lit(None).cast("long").alias(x) for x in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], F.lit(None).cast("string").alias("ends_sha256")).limit(0)
    going = retired.join(sets.select("rep", "weight", "len"), "rep")
    whole = alone.groupBy("conv_id").agg(F.sum("points").alias("whole")).withColumnRenamed("conv_id", "rep")
    going = materialize(going.join(whole, "rep"), "trie-going")
    tail = going.join(alone.withColumnRenamed("conv_id", "rep"), "rep").where("place > depth")
    # The weight of a chain is the same all along, so a suffix sum gives what it saves.
    chain = tail.select(
        F.col("rep").alias("conv_id"), F.col("place").alias("depth"), F.col("rep").alias("parent"), F.col("weight").alias("n_convs"), (F.col("place") < F.col("len")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("weight") - 1) * (F.col("whole") - F.col("upto") + F.col("points"))).alias("saved_tokens"), F.when(F.col("place") == F.col("len"), F.col("rep")).alias("end"),
    )
    chain = materialize(chain, "trie-chain")
    tops = chain.join(going.select(F.col("rep").alias("conv_id"), (F.col("depth") + 1).cast("long").alias("depth")), ["conv_id", "depth"]).select(F.col("conv_id").alias("rep"), F.col("saved_tokens").alias("below"))
    nodes = fold_back(levels, materialize(tops, "trie-tails")).select(*chain.columns).unionByName(chain)
    named = nodes.join(sets.select(F.col("rep").alias("end"), "ends_sha256"), "end", "left")
    return named.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
