"""Z-fast trie of conversations: compacted nodes, found by hashes of prefixes.

Every prefix of a sequence of turns has a hash of 128 bits: the sum of hashes of (position, role, text), so hashes of all
prefixes are running sums. A compacted node is a prefix at which sequences part or end; its edge goes from
the depth of the compacted node above it (exclusive) to its own depth. The trie is a table of nodes, each with its handle:
the hash of the prefix whose depth is the two-fattest number of the edge (the one that 2 divides most often).

1. Equal sequences are one, with their number and smallest conversation; they come in batches.
2. A sequence finds its exit node by fat binary search: it looks for the handle at the two-fattest depth of the range that
   is left. A handle that is there leads to its node's depth; one that isn't ends the range before it. Then the edge
   that begins with the sequence's next turn, if there is one, is halved to find where the sequence leaves it. Every
   step is an equal-join of all sequences with the table; there are as many steps as twice the logarithm of the longest sequence.
3. Edges that are left half-way are split; what lies beyond the exits becomes new nodes where sequences of the batch
   part or end. Prefixes that the trie has already are not looked at again.
4. Sums over subtrees (conversations, leaves, words) go up in jumps of 1, 2, 4, ... compacted nodes.
5. Edges are expanded: a row for each depth of an edge, read from one sequence that passes it.

Rows with a null conv_id are left out (a negative one's remainder is negative, as in SQL); null roles and texts are empty. Turns are ordered by turn (nulls first), then role
and text; a conversation may have any number of them: positions and prefix hashes are running sums over ranges. Rows repeated
in full are turns of their own. An empty table gives an empty result. Only the four columns are read. The digest of
the conversations that end at a node reads their ids one after another, as a stream; nothing else gathers a node's rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import numbered, running
from .common import materialise

STRIDE, HEADS = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
BATCHES = (1, 4, 11)  # sixteenths of the sequences
TOGETHER = 2  # steps of the search between two written tables
BLOCK = 4096  # depths of an edge that are expanded at once
HALF = (1 << 32) - 1
NODE = ["d", "p", "q", "up", "upp", "upq", "rep", "hd", "hp", "hq", "sp", "sq", "w", "upw"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, words): positions from 1, two hashes of (role, text), words of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    placed = numbered(rows, ["conv_id"], [F.asc_nulls_first("turn"), "role", "text"], "pos")
    return placed.select("conv_id", "pos", F.xxhash64(F.lit("a"), "role", "text").alias("a"), F.xxhash64(F.lit("b"), "role", "text").alias("b"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """turns, where each conversation c has its first h turns from conversation c - c % stride (h: crc32 of c's decimal
    form % heads), and (conv_id, n) of all conversations, those without turns too."""
    sizes = materialise(turns.groupBy("conv_id").agg(F.max("pos").alias("own")))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_n"))
    convs = sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % stride).alias("base")).join(base, "base", "left")
    convs = convs.select("conv_id", "own", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("m"))
    convs = materialise(convs.withColumn("n", F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("m")))
    first = turns.where((F.col("pos") < heads) & (F.col("conv_id") % stride == 0)).withColumnRenamed("conv_id", "base")
    taken = convs.where("m > 0").join(first, "base").where("pos <= h").select("conv_id", "pos", "a", "b", "words")
    kept = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("pos > h")
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "a", "b", "words")
    return kept.unionByName(taken), convs.select("conv_id", "n")


def prefixes(turns: DataFrame) -> DataFrame:
    """(x, d, p, q, pp, pq, w, w0) of every turn: hash of the prefix that ends with it and of the one before it, words up
    to it and before it."""
    one, two = (F.xxhash64(F.lit(k), "pos", "a", "b") for k in ("p", "q"))
    parts = {"p1": F.shiftrightunsigned(one, 32), "p2": one.bitwiseAND(F.lit(HALF)), "q1": F.shiftrightunsigned(two, 32), "q2": two.bitwiseAND(F.lit(HALF))}
    rows = turns.withColumns({f"own_{k}": c for k, c in parts.items()})
    sums = running(rows, ["conv_id"], ["pos"], {k: F.col(f"own_{k}") for k in parts} | {"w0": F.col("words")})
    glued = lambda x, y: F.shiftleft(x.bitwiseAND(F.lit(HALF)), 32).bitwiseOR(y.bitwiseAND(F.lit(HALF)))
    before = [glued(F.col(f"{k}1"), F.col(f"{k}2")) for k in "pq"]
    here = [glued(F.col(f"{k}1") + F.col(f"own_{k}1"), F.col(f"{k}2") + F.col(f"own_{k}2")) for k in "pq"]
    return sums.select(F.col("conv_id").alias("x"), F.col("pos").alias("d"), here[0].alias("p"), here[1].alias("q"), before[0].alias("pp"), before[1].alias("pq"), (F.col("w0") + F.col("words")).alias("w"), "w0")


def fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] that 2 divides most often."""
    differs = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), differs))


def root_table(paths: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return paths.sparkSession.range(1).select(*[(F.lit(None).cast("long") if c in ("upp", "upq", "rep") else F.lit(-1).cast("long") if c == "up" else zero).alias(c) for c in NODE])


def looked_up(rows: DataFrame, paths: DataFrame, x: str | Column, d: str | Column, **named: str) -> DataFrame:
    """rows with columns of the path row of (x, d), null where there is none. named: new name to column of paths."""
    at = paths.select(F.col("x").alias("hf_x"), F.col("d").alias("hf_d"), *[F.col(c).alias(n) for n, c in named.items()])
    x, d = (F.col(c) if isinstance(c, str) else c for c in (x, d))
    return rows.withColumns({"hf_key": x, "hf_depth": d}).join(at, (F.col("hf_key") == F.col("hf_x")) & (F.col("hf_depth") == F.col("hf_d")), "left").drop("hf_x", "hf_d", "hf_key", "hf_depth")


def locate(paths: DataFrame, nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """queries (x, n, ...) with e, the depth down to which the trie has the sequence; vd, vp, vq, the compacted node that it
    is in, or whose edge it leaves; and inside, whether it leaves half-way of that node's edge."""
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = nodes.where("d > 0").select("hd", "hp", "hq", "sp", "sq", "up", F.col("p").alias("np"), F.col("q").alias("nq"), F.col("d").alias("nd"), F.col("rep").alias("nrep"))
    handles = own.select(F.lit(0).alias("k_kind"), F.col("hd").alias("k_d"), F.col("hp").alias("k_p"), F.col("hq").alias("k_q"), "np", "nq", "nd", "nrep")
    handles = handles.unionByName(own.select(F.lit(1).alias("k_kind"), (F.col("up") + 1).alias("k_d"), F.col("sp").alias("k_p"), F.col("sq").alias("k_q"), "np", "nq", "nd", "nrep"))
    cols = [*queries.columns, "lo", "hi", "mode", "vd", "vp", "vq", "rep"]
    state = queries.withColumns({"lo": zero, "hi": F.col("n"), "mode": F.lit(0), "vd": zero, "vp": zero, "vq": zero, "rep": none})
    live = ((F.col("mode") == 0) & ((F.col("lo") < F.col("hi")) | (F.col("lo") < F.col("n")))) | ((F.col("mode") == 1) & (F.col("lo") < F.col("hi")))

    def step(state: DataFrame) -> DataFrame:
        """mode 0: searching (by handles, then once by the edge's first turn); 1: inside an edge; 2: there is no edge."""
        inside, child = F.col("mode") == 1, (F.col("mode") == 0) & (F.col("lo") == F.col("hi"))
        f = F.when(live, F.when(inside, F.expr("(lo + hi + 1) div 2")).when(child, F.col("lo") + 1).when(F.col("mode") == 0, fattest(F.col("lo"), F.col("hi"))))
        s = looked_up(state.withColumn("f", f), paths, "x", "f", fp="p", fq="q")
        key = {"j_kind": F.when(child, 1).otherwise(0), "j_p": F.when(~inside, F.col("fp")), "j_q": F.when(~inside, F.col("fq"))}
        s = s.withColumns(key).join(handles, (F.col("j_kind") == F.col("k_kind")) & (F.col("f") == F.col("k_d")) & (F.col("j_p") == F.col("k_p")) & (F.col("j_q") == F.col("k_q")), "left")
        s = looked_up(s, paths, F.when(inside, F.col("rep")).when(F.col("nd") <= F.col("n"), F.col("x")), F.when(inside, F.col("f")).when(F.col("nd") <= F.col("n"), F.col("nd")), gp="p", gq="q")
        on = F.col("f").isNotNull()
        same = F.coalesce((F.col("fp") == F.col("gp")) & (F.col("fq") == F.col("gq")), F.lit(False))
        hit = on & ~inside & F.col("nd").isNotNull()
        reached = hit & F.coalesce((F.col("gp") == F.col("np")) & (F.col("gq") == F.col("nq")), F.lit(False))
        partly = hit & ~reached
        new = {
            "lo": F.when(on & inside & same | partly, F.col("f")).when(reached, F.col("nd")).otherwise(F.col("lo")),
            "hi": F.when(partly, F.least(F.col("nd") - 1, F.col("n"))).when(on & inside & same | hit | child, F.col("hi")).when(on, F.col("f") - 1).otherwise(F.col("hi")),
            "mode": F.when(partly, 1).when(on & child & ~hit, 2).otherwise(F.col("mode")),
            "vd": F.when(hit, F.col("nd")).otherwise(F.col("vd")), "vp": F.when(hit, F.col("np")).otherwise(F.col("vp")), "vq": F.when(hit, F.col("nq")).otherwise(F.col("vq")),
            "rep": F.when(partly, F.col("nrep")).otherwise(F.col("rep")),
        }
        return s.select(*queries.columns, *[c.alias(n) for n, c in new.items()]).select(cols)

    while not state.where(live).isEmpty():
        for _ in range(TOGETHER):
            state = step(state)
        state = materialise(state)
    return state.select(*queries.columns, F.col("lo").alias("e"), "vd", "vp", "vq", (F.col("mode") == 1).alias("inside"))


def with_handles(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """nodes (d, p, q, up, upp, upq, rep) with handle, first hash of the edge, and words down to both ends of the edge."""
    nodes = looked_up(nodes.withColumn("hd", fattest(F.col("up"), F.col("d"))), paths, "rep", "hd", hp="p", hq="q")
    nodes = looked_up(nodes, paths, "rep", F.col("up") + 1, sp="p", sq="q", upw="w0")
    return looked_up(nodes, paths, "rep", "d", w="w").select(NODE)


def insert(paths: DataFrame, nodes: DataFrame, located: DataFrame) -> DataFrame:
    """nodes after the located sequences (x, n, p, q of the whole, e, vd, vp, vq, inside) have been put in."""
    zero = F.lit(0).cast("long")
    exits = looked_up(located, paths, "x", "e", ep="p", eq="q").withColumns({"ep": F.coalesce("ep", zero), "eq": F.coalesce("eq", zero)})
    exits = materialise(exits)
    cuts = exits.where("inside").groupBy("vd", "vp", "vq", "e", "ep", "eq").agg(F.min("x").alias("by"))
    cuts = materialise(cuts)
    down = Window.partitionBy("vd", "vp", "vq").orderBy("e")
    whole = nodes.select(F.col("d").alias("vd"), F.col("p").alias("vp"), F.col("q").alias("vq"), "up", "upp", "upq")
    split = cuts.select("*", *[F.lag(c).over(down).alias(f"l{c}") for c in ("e", "ep", "eq")]).join(whole, ["vd", "vp", "vq"])
    split = split.select(F.col("e").alias("d"), F.col("ep").alias("p"), F.col("eq").alias("q"), *[F.coalesce(f"l{a}", b).alias(b) for a, b in (("e", "up"), ("ep", "upp"), ("eq", "upq"))], F.col("by").alias("rep"))
    tails = exits.where("e < n").select(F.col("x"), "n", "e", "ep", "eq").join(paths.drop("w", "w0"), "x").where("d > e")
    apart = tails.where(F.col("d") > F.col("e") + 1).groupBy((F.col("d") - 1).alias("d"), F.col("pp").alias("p"), F.col("pq").alias("q"))
    apart = apart.agg(*[f(c).alias(f"{n}_{c}") for c in ("p", "q") for n, f in (("min", F.min), ("max", F.max))]).where("min_p <> max_p or min_q <> max_q").select("d", "p", "q")
    marks = apart.unionByName(exits.where("e < n").select(F.col("n").alias("d"), "p", "q")).distinct()
    marked = tails.select("x", "e", "ep", "eq", "d", "p", "q").join(marks, ["d", "p", "q"])
    along = Window.partitionBy("x").orderBy("d")
    marked = marked.select("d", "p", "q", "x", *[F.coalesce(F.lag(a).over(along), b).alias(u) for a, b, u in (("d", "e", "up"), ("p", "ep", "upp"), ("q", "eq", "upq"))])
    fresh = marked.groupBy("d", "p", "q").agg(*[F.min(c).alias(c) for c in ("up", "upp", "upq")], F.min("x").alias("rep"))
    lowest = cuts.groupBy(F.col("vd").alias("d"), F.col("vp").alias("p"), F.col("vq").alias("q")).agg(F.max(F.struct("e", "ep", "eq")).alias("low"))
    held = nodes.join(lowest, ["d", "p", "q"], "left_anti")
    moved = nodes.select("d", "p", "q", "rep").join(lowest, ["d", "p", "q"]).select("d", "p", "q", F.col("low.e").alias("up"), F.col("low.ep").alias("upp"), F.col("low.eq").alias("upq"), "rep")
    return materialise(held.unionByName(with_handles(split.unionByName(fresh).unionByName(moved), paths)))


def build(paths: DataFrame, strings: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """The table of compacted nodes of all sequences. strings: x, n, p, q of each different one; paths: theirs."""
    nodes = materialise(root_table(paths))
    share, begin, whole = F.pmod(F.xxhash64("p", "q"), F.lit(sum(batches))), 0, strings.where("n > 0")
    zero = F.lit(0).cast("long")
    for i, size in enumerate(batches):
        batch = whole.where((share >= begin) & (share < begin + size)).select("x", "n", "p", "q")
        begin += size
        located = locate(paths, nodes, batch) if i else batch.withColumns({"e": zero, "vd": zero, "vp": zero, "vq": zero, "inside": F.lit(False)})
        nodes = insert(paths, nodes, located)
    return nodes


def summed(nodes: DataFrame, strings: DataFrame) -> DataFrame:
    """nodes with copies (conversations that end there), children, and sums over subtrees: convs, least, leaves, ended
    (copies times words down to their node) and words (of all edges, the node's own too)."""
    key = ["d", "p", "q"]
    kids = nodes.where("d > 0").groupBy(F.col("up").alias("d"), F.col("upp").alias("p"), F.col("upq").alias("q")).agg(F.count("*").alias("children"))
    own = nodes.join(kids, key, "left").join(strings.select(F.col("n").alias("d"), "p", "q", "copies", F.col("x").alias("first")), key, "left")
    own = own.withColumns({"children": F.coalesce("children", F.lit(0)), "copies": F.coalesce("copies", F.lit(0))})
    sums = {"convs": F.col("copies"), "leaves": (F.col("children") == 0).cast("long"), "ended": F.col("copies") * F.col("w"), "words": F.col("w") - F.col("upw")}
    state = own.withColumns(sums | {"least": F.col("first")} | {f"j{k}": F.when(F.col("d") > 0, F.col(c)) for k, c in (("d", "up"), ("p", "upp"), ("q", "upq"))})
    state = materialise(state.drop("first"))
    jump = [F.col(f"j{k}").alias(k) for k in key]
    while not state.where("jd is not null").isEmpty():
        given = state.where("jd is not null").groupBy(*jump).agg(*[F.sum(c).alias(f"g_{c}") for c in sums], F.min("least").alias("g_least"))
        state = state.join(given, key, "left").withColumns({c: F.col(c) + F.coalesce(f"g_{c}", F.lit(0)) for c in sums} | {"least": F.least("least", "g_least")})
        further = state.select(*[F.col(k).alias(f"f{k}") for k in key], *[F.col(f"j{k}").alias(f"n{k}") for k in key])
        state = state.join(further, (F.col("jd") == F.col("fd")) & (F.col("jp") == F.col("fp")) & (F.col("jq") == F.col("fq")), "left")
        state = materialise(state.select(*NODE, "copies", "children", *sums, "least", *[F.col(f"n{k}").alias(f"j{k}") for k in key]))
    return state.drop("jd", "jp", "jq")


def digests(ends: DataFrame) -> DataFrame:
    """(d, p, q, ends_sha256): of the decimal conv_ids that end at a node, ascending, comma-joined. Read as a stream."""

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        state, done = hashlib.sha256(), []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [[], [], [], []]
            done.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["d", "p", "q", "ends_sha256"])

        for batch in batches:
            if not len(batch):
                continue
            d, p, q, ids = (batch.column(c).to_numpy() for c in ("d", "p", "q", "conv_id"))
            starts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])).tolist()
            for a, b in zip(starts, [*starts[1:], len(d)], strict=True):
                node, text = (int(d[a]), int(p[a]), int(q[a])), ",".join(map(str, ids[a:b].tolist()))
                if node == at:
                    state.update(f",{text}".encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = node, hashlib.sha256(text.encode())
            yield flushed()
        if at is not None:
            done.append((*at, state.hexdigest()))
        yield flushed()

    return ends.repartition("d", "p", "q").sortWithinPartitions("d", "p", "q", "conv_id").select("d", "p", "q", "conv_id").mapInArrow(streamed, "d long, p long, q long, ends_sha256 string")


def expand(nodes: DataFrame, paths: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over its subtree, words of a prefix's last text times its members but one), ends_sha256."""
    none = F.lit(hashlib.sha256(b"").hexdigest())
    nodes = nodes.join(digests(ends), ["d", "p", "q"], "left")
    above = nodes.select(F.col("d").alias("up"), F.col("p").alias("upp"), F.col("q").alias("upq"), F.col("least").alias("above"))
    edges = nodes.where("d > 0").join(above, ["up", "upp", "upq"])
    blocks = edges.withColumn("block", F.explode(F.sequence(F.col("up") + 1, F.col("d"), F.lit(BLOCK).cast("long"))))
    each = blocks.withColumn("depth", F.explode(F.sequence("block", F.least(F.col("d"), F.col("block") + (BLOCK - 1)))))
    each = looked_up(each, paths, "rep", "depth", before="w0")
    last = F.col("depth") == F.col("d")
    rows = each.select(
        F.col("least").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("up") + 1, F.col("above")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("ended") - F.col("convs") * F.col("before") - F.col("words") + F.col("before") - F.col("upw")).alias("saved_tokens"), F.when(last, F.coalesce("ends_sha256", none)).otherwise(none).alias("ends_sha256"),
    )
    root = nodes.where("d = 0 and least is not null").select(
        F.col("least").alias("conv_id"), F.col("d").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("convs").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("ended") - F.col("words")).alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
    return rows.unionByName(root)


def sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(paths, strings, ends): prefixes of one conversation for each different sequence; the different sequences (x, n, p,
    q, copies); where each conversation ends (d, p, q, conv_id). turns: conv_id, pos, a, b, words; convs: conv_id, n."""
    paths = materialise(prefixes(turns))
    zero = F.lit(0).cast("long")
    ends = looked_up(convs, paths, "conv_id", "n", p="p", q="q").select(F.col("n").alias("d"), F.coalesce("p", zero).alias("p"), F.coalesce("q", zero).alias("q"), "conv_id")
    ends = materialise(ends)
    strings = materialise(ends.groupBy(F.col("d").alias("n"), "p", "q").agg(F.min("conv_id").alias("x"), F.count("*").alias("copies")))
    return materialise(paths.join(strings.select("x"), "x", "left_semi")), strings, ends


def prefix_trie(turns: DataFrame, convs: DataFrame, batches: tuple[int, ...] = BATCHES) -> DataFrame:
    """All prefixes of all sequences, as expand gives them."""
    paths, strings, ends = sequences(turns, convs)
    return expand(summed(build(paths, strings, batches), strings), paths, ends)
