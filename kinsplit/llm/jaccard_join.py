"""Near-duplicate documents: Jaccard join of word shingles, filtered by a count-vector R-tree.

A document's shingles are hashed to 64 bits and fall into groups by their leading bits;
the counts of the groups are a point. The coordinate minima of two points sum up to a
bound on the shingles in common, and the same holds for a point and the upper corner of
a box, so an R-tree over the points finds all partners that may reach the threshold.
Pairs that survive are verified on the sets themselves.

One tree over a whole corpus would meet in one place, so points are dealt into blocks:
documents that can reach the threshold share a shingle among the first fifth of their
shingles (frequent ones last, else by hash), and for the smaller document even among its
first ninth. Documents with equal sets are one node from the start. A block's nodes are
first compared with three of their own as heads; nodes that are then connected need no
further link, and only blocks that still hold several components are searched by tree,
in cells of at most ``CELL`` nodes against ``CELL``: first for the most promising
partner of each node, in the end for all. No link between components is lost.

Order, cells and heads steer the work only; the links found do not depend on them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinsplit.llm.tokens import shingle_hashes, text_bytes, word_hashes
from kinsplit.llm.util import small_batches
from kinsplit.llm.worker import let_go, release
from kinsplit.plans.components import connected_components
from kinsplit.plans.scratch import stored

WORDS, PERCENT = 5, 80
#: Groups of a point by the size of its set: a bound needs about n/25 groups, and tells more with more.
GROUPS = ((64, 64), (2048, 256), (1 << 62, 1024))
CELL, FANOUT, SALTS = 1024, 32, 64
#: Frequent shingles that are ordered last: at most so many, counted over all documents.
FREQUENT, LEAST_COUNT, SUMMARY = 20_000, 20, 200_000
BROADCAST_ROWS = 500_000
EMIT_ROWS = 100_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; empty without words."""
    return np.unique(shingle_hashes(word_hashes(text_bytes(text)), WORDS))


def node_of(hashes: np.ndarray) -> int:
    """A 63-bit name for a set of shingles."""
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little") >> 1


def needed(na, nb):
    """Least number of common shingles for two sets of these sizes to link."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def prefix_lengths(n: int) -> tuple[int, int]:
    """Shingles to compare with any partner, and with partners that are not smaller."""
    return n - -(-PERCENT * n // 100) + 1, n - needed(n, n) + 1


def point(hashes: np.ndarray) -> np.ndarray:
    """Counts of shingles by group."""
    groups = next(g for limit, g in GROUPS if len(hashes) < limit)
    return np.bincount((hashes >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups)


def narrowed(p: np.ndarray, groups: int) -> np.ndarray:
    """The point with fewer groups: neighbours share their leading bits."""
    return p if len(p) == groups else p.reshape(groups, -1).sum(1)


def may_link(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether the summed minima of two points reach what their sets need."""
    groups = min(len(p), len(q))
    p, q = narrowed(p, groups), narrowed(q, groups)
    return int(np.minimum(p, q).sum()) >= needed(int(p.sum()), int(q.sum()))


class RTree:
    """Points packed by size into boxes of ``FANOUT``, and these again, up to one level."""

    def __init__(self, points: np.ndarray):
        sizes = points.sum(1)
        self.order = np.lexsort((points[:, 0], sizes))
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []
        upper, low = self.points, self.sizes
        while len(upper) > FANOUT:
            at = np.arange(0, len(upper), FANOUT)
            upper, low = np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(low, at)
            self.levels.append((upper, low))

    def partners(self, q: np.ndarray) -> np.ndarray:
        """Positions of points whose summed minima with ``q`` reach what both need."""
        size = q.sum()
        rows = None
        for upper, low in [*reversed(self.levels), (self.points, self.sizes)]:
            rows = np.arange(len(upper)) if rows is None else rows[rows < len(upper)]
            rows = rows[np.minimum(upper[rows], q).sum(1) >= needed(size, low[rows])]
            if upper is not self.points:
                rows = (rows[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        return self.order[rows]


def search(points: list[np.ndarray], left: np.ndarray, right: np.ndarray, component: np.ndarray, best: bool = False) -> list[tuple[int, int]]:
    """Pairs of a left and a right member, of different components, that may link.

    With ``best`` only the partner of the highest bound for each left member.
    """
    found = set()
    widths = np.array([len(p) for p in points])
    top: dict[int, tuple[float, int]] = {}
    for groups in sorted(set(widths)):  # a pair meets at the width of its smaller member
        rows_r = right[widths[right] >= groups]
        rows_l = left[widths[left] >= groups]
        if not len(rows_r) or not len(rows_l):
            continue
        own = np.array([narrowed(points[i], groups) for i in rows_r])
        sizes = own.sum(1)
        narrow = widths[rows_r] == groups
        tree = RTree(own) if len(rows_r) > FANOUT else None
        for i in rows_l.tolist():
            q = narrowed(points[i], groups)
            near = component[rows_r] != component[i]
            if widths[i] != groups:
                near &= narrow
            if tree is None:
                at = np.flatnonzero(near)
            else:
                at = tree.partners(q)
                at = at[near[at]]
            if not len(at):
                continue
            common, least = np.minimum(own[at], q).sum(1), needed(int(q.sum()), sizes[at])
            at, ratio = at[common >= least], (common / least)[common >= least]
            if best and len(at):
                k = int(ratio.argmax())
                top[i] = max(top.get(i, (0.0, -1)), (float(ratio[k]), int(rows_r[at[k]])))
            else:
                found.update((min(i, j), max(i, j)) for j in rows_r[at].tolist())
    found.update((min(i, j), max(i, j)) for i, (_, j) in top.items())
    return sorted(found)


class Frequent:
    """A bounded summary of the most frequent shingles that a task has met."""

    def __init__(self):
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.held: list[np.ndarray] = []
        self.size = 0

    def add(self, shingles: np.ndarray) -> None:
        self.held.append(shingles)
        self.size += len(shingles)
        if self.size >= 4 * SUMMARY:
            self._settle()

    def _settle(self) -> None:
        if not self.held:
            return
        new, n = np.unique(np.concatenate(self.held), return_counts=True)
        if self.size >= SUMMARY:  # a shingle once in many documents is not frequent here
            new, n = new[n > 1], n[n > 1]
        keys, at = np.unique(np.concatenate([self.keys, new]), return_inverse=True)
        counts = np.bincount(at, np.concatenate([self.counts, n]), len(keys)).astype(np.int64)
        if len(keys) > SUMMARY:
            top = np.sort(np.argpartition(-counts, SUMMARY)[:SUMMARY])
            keys, counts = keys[top], counts[top]
        self.keys, self.counts, self.held, self.size = keys, counts, [], 0

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """At most ``FREQUENT`` shingles met twice or more, and their counts."""
        self._settle()
        top = np.argsort(-self.counts, kind="stable")[:FREQUENT]
        top = top[self.counts[top] > 1]
        return self.keys[top], self.counts[top]


_SHAPES = "doc_id string, text_hash long, n_shingles long, node long, point binary, shingle long, n long"


def shapes_and_frequent(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """One pass over all texts, written once.

    doc_id, text_hash, n_shingles, node and point of every row (node is null without words);
    and the most frequent shingles of all, at most ``FREQUENT``, by ascending count. Each task
    adds its summary of these to its rows; the summaries are added up.
    """

    def shape(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(doc_ids, hashes, found, keys, counts) -> pd.DataFrame:
            column = lambda values, kind="Int64": pd.Series(list(values), dtype=kind)
            return pd.DataFrame({"doc_id": column(doc_ids, object), "text_hash": column(hashes), "n_shingles": column(r[0] for r in found), "node": column(r[1] for r in found), "point": column((r[2] for r in found), object), "shingle": column(keys), "n": column(counts)})

        let_go()
        frequent = Frequent()
        for part in batches:
            found = []
            for text in part.text:
                own = shingles(text)
                frequent.add(own)
                found.append((len(own), node_of(own), point(own).astype("<u2" if len(own) < 65536 else "<u4").tobytes()) if len(own) else (0, None, None))
            none = [None] * len(found)
            yield rows([None if pd.isna(d) else d for d in part.doc_id], part.text_hash, found, none, none)
        keys, counts = frequent.top()
        none = [None] * len(keys)
        yield rows(none, none, [(None, None, None)] * len(keys), keys.view(np.int64), counts)

    # Ids above 2**53 would not survive pandas' floats, which columns with nulls become.
    read = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    both = stored(read.mapInPandas(shape, _SHAPES))
    summed = both.filter("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    rows = summed.orderBy(F.desc("n"), "shingle").limit(FREQUENT).collect()
    every = both.filter("shingle is null").select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text_hash", "n_shingles", "node", "point")
    return every, np.array([r.shingle for r in reversed(rows)], np.int64).view(np.uint64)


def signatures(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(sig, node, short, hot): prefix shingles of each set; ``short`` marks its first ninth, ``hot`` frequent ones."""
    by_hash = np.argsort(frequent, kind="stable")
    shared = docs.sparkSession.sparkContext.broadcast((frequent[by_hash], by_hash + 1))  # at most FREQUENT entries

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        hot, rank = shared.value
        done: set[int] = set()

        def rows(out: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pd.DataFrame:
            sizes = [len(o[0]) for o in out]
            short = np.concatenate([np.arange(n) < o[3] for n, o in zip(sizes, out)])
            return pd.DataFrame({"sig": np.concatenate([o[0] for o in out]), "node": np.repeat([o[2] for o in out], sizes), "short": short, "hot": np.concatenate([o[1] for o in out])})

        for part in batches:
            out, held = [], 0
            for text in part.text:
                own = shingles(text)
                if not len(own):
                    continue
                node = node_of(own)
                if node in done:  # another copy in this task
                    continue
                if len(done) < 200_000:
                    done.add(node)
                long, short = prefix_lengths(len(own))
                late = np.zeros(len(own), np.int64)
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                    late = np.where(hot[at] == own, rank[at], 0)
                order = np.argsort(late, kind="stable")[:long]
                out.append((own[order].view(np.int64), late[order] > 0, node, short))
                held += long
                if held >= EMIT_ROWS:  # a batch of texts has many times as many rows
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    return docs.select("text").mapInPandas(emit, "sig long, node long, short boolean, hot boolean")


def _points(column: pd.Series, sizes: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(p, "<u2" if n < 65536 else "<u4").astype(np.int64) for p, n in zip(column, sizes)]


def _verified(pairs: DataFrame, docs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose sets reach the threshold."""

    @F.pandas_udf("binary")
    def set_of(texts: pd.Series, names: pd.Series) -> pd.Series:
        own = map(shingles, texts)  # null where another text has the same hash
        release()
        return pd.Series([x.tobytes() if node_of(x) == n else None for x, n in zip(own, names)])

    @F.pandas_udf("boolean")
    def links(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * common >= PERCENT * (len(x) + len(y) - common))
        release()
        return pd.Series(out, dtype=bool)

    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = stored(named.join(shapes.select("node", "text_hash"), "node"))
    # 16 bytes a row; beyond the bound both sides are shuffled.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    texts = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(side, "text_hash")
    sets = texts.select("node", set_of("text", "node").alias("shingles")).filter("shingles is not null").groupBy("node").agg(F.min("shingles").alias("shingles"))
    sets = stored(sets)
    left, right = (sets.withColumnsRenamed({"node": end, "shingles": f"set_{end}"}) for end in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").filter(links("set_a", "set_b")).select("a", "b")


def _bounded(pairs: DataFrame, shapes: DataFrame) -> DataFrame:
    """The pairs whose sizes and points allow a link."""

    @F.pandas_udf("boolean")
    def allowed(p: pd.Series, m: pd.Series, q: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([may_link(x, y) for x, y in zip(_points(p, m), _points(q, n))], dtype=bool)

    left, right = (shapes.select(F.col("node").alias(e), F.col("n_shingles").alias(f"n_{e}"), F.col("point").alias(f"p_{e}")) for e in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(allowed(F.col("p_a"), F.col("n_a"), F.col("p_b"), F.col("n_b"))).select("a", "b")


def _searched(blocks: DataFrame, shapes: DataFrame, labels: DataFrame, best: bool) -> DataFrame:
    """Pairs of nodes in different components that a block's tree finds; all, or the best of each node."""
    labelled = blocks.filter("members > 2").join(labels.withColumnRenamed("vertex", "node"), "node", "left").select("sig", "node", F.coalesce("component", "node").alias("component"), "members")
    several = labelled.groupBy("sig").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most").select("sig")
    open_ = labelled.join(several, "sig")
    cells = F.ceil(F.col("members") / CELL).cast("int")
    dealt = open_.withColumns({"own": F.pmod(F.xxhash64("node", "sig"), cells).cast("int"), "other": F.explode(F.sequence(F.lit(0), cells - 1))})
    dealt = dealt.select("sig", F.least("own", "other").alias("row"), F.greatest("own", "other").alias("col"), "own", "node", "component")
    pointed = dealt.join(shapes.select("node", "n_shingles", "point"), "node").repartition("sig", "row", "col").sortWithinPartitions("sig", "row", "col")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        rest: pd.DataFrame | None = None
        seen: set[tuple[int, int]] = set()  # pairs meet in many blocks
        for part in batches:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            key = part[["sig", "row", "col"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else []
            yield _search_groups(part, starts[:-1], starts[1:], best, seen)
            rest = part.iloc[starts[-1] :] if len(starts) else None
        if rest is not None:
            yield _search_groups(rest, [0], [len(rest)], best, seen)

    return pointed.mapInPandas(scan, "a long, b long").distinct()


def _search_groups(part: pd.DataFrame, starts, stops, best: bool, seen: set[tuple[int, int]]) -> pd.DataFrame:
    node, component, own, row, col = (part[c].to_numpy() for c in ("node", "component", "own", "row", "col"))
    out = set()
    for start, stop in zip(starts, stops):
        points = _points(part.point.iloc[start:stop], part.n_shingles.iloc[start:stop])
        mine = own[start:stop]
        left, right = np.flatnonzero(mine == row[start]), np.flatnonzero(mine == col[start])
        for i, j in search(points, left, right, component[start:stop], best):
            a, b = int(node[start + i]), int(node[start + j])
            if a != b:
                out.add((max(a, b), min(a, b)))
    new = sorted(out - seen)
    if len(seen) > 100_000:
        seen.clear()
    seen.update(new)
    return pd.DataFrame(new, columns=["a", "b"], dtype="int64")


def _blocks(sigs: DataFrame) -> DataFrame:
    """(sig, node, lo, hi, mid, members, same, total): the nodes of each block of two or more that hold a link's ends.

    ``lo``, ``hi`` and ``mid`` are members, to serve as heads; blocks of the same nodes, as
    those of a group of copies, agree in ``members``, ``lo``, ``hi``, the xor of the nodes' names
    (``same``) and the sum of another hash of these (``total``). A frequent shingle's block is dealt over ``SALTS``
    parts; what these say of their nodes is added up, a row for each frequent shingle and part.
    Any other shingle stands in no more rows than the least of ``FREQUENT`` frequent ones.
    """
    within = Window.partitionBy("sig", "salt")
    # A set has a row for each task that met a copy of it; one is kept, so that a block lists each node once.
    again = F.lag("node").over(within.orderBy("node"))
    facts = {"lo": F.min("node"), "hi": F.max("node"), "any_short": F.max("short")}
    more = {"mid": F.min_by("node", F.xxhash64("node")), "members": F.count("*"), "same": F.bit_xor("node"), "total": F.sum(F.shiftrightunsigned(F.xxhash64("node"), 32))}
    linked = (F.col("lo") != F.col("hi")) & F.col("any_short")
    parts = stored(
        sigs.withColumn("salt", F.when(F.col("hot"), F.pmod("node", F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
        .withColumn("again", again)
        .filter("again is null or again <> node")
        .withColumns({name: fact.over(within) for name, fact in facts.items()})
        .filter(F.col("hot") | linked)
        .withColumns({name: fact.over(within) for name, fact in more.items()})
        .drop("again", "short")
    )
    columns = ["sig", "node", "lo", "hi", "mid", "members", "same", "total"]
    hot = parts.filter("hot")
    summed = hot.drop("node").distinct().groupBy("sig").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("any_short").alias("any_short"), F.min_by("mid", F.xxhash64("mid")).alias("mid"), F.sum("members").alias("members"), F.bit_xor("same").alias("same"), F.sum("total").alias("total"))
    whole = hot.select("sig", "node").join(F.broadcast(summed.filter(linked)), "sig")  # at most FREQUENT rows
    return parts.filter("not hot").select(*columns).unionByName(whole.select(*columns))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and component (one of its nodes) of every row; null without words.

    All that Python workers do is done, and written, when this returns.
    """
    with small_batches(docs.sparkSession):  # pairs of sets are wide rows
        return _components(docs)


def _components(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    every, frequent = shapes_and_frequent(docs)
    # Any text of a node has its set, so the one of least hash stands for it.
    shapes = stored(every.filter("node is not null").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("n_shingles").alias("n_shingles"), F.min("point").alias("point")))
    shared = stored(_blocks(signatures(docs, frequent)))
    once = shared.groupBy("same", "total", "members", "lo", "hi").agg(F.min("sig").alias("sig")).select("sig")
    blocks = stored(shared.join(once, "sig"))
    heads = F.explode(F.array_distinct(F.array("lo", "hi", "mid")))
    star = blocks.select("node", heads.alias("head")).filter("node <> head").select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct()
    tried = stored(_bounded(star, shapes))
    links = stored(_verified(tried, docs, shapes))
    labels = connected_components(links)
    # Twice the most promising partner of each node; then all pairs that are still between
    # components, so that nothing is left out. What was compared is not compared again.
    for best in (True, True, False):
        pairs = stored(_searched(blocks, shapes, labels, best).join(tried, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            if best:
                continue
            break
        more = stored(_verified(pairs, docs, shapes))
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            labels = connected_components(links)
    named = every.join(labels.withColumnRenamed("vertex", "node"), "node", "left")
    return named.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "node").alias("component"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links) of every row.

    Rows without words (null, empty, white space) link with nothing, not even each other:
    their component is their own id. Equal texts link. A row with a null doc_id takes part
    and never names a component, unless all of it are such rows: then it is null. Rows that
    share a doc_id are rows of their own. Only doc_id and text are read.
    """
    named = components(docs)
    # Written, so that the join stands apart from the sums and a large component's rows can be split.
    least = stored(named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    joined = named.join(least, "component", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one of smallest doc_id (null last).

    Rows without words all stay. Of rows that agree in doc_id and text one stays. All
    columns are kept as they are.
    """
    named = stored(components(docs).filter("component is not null"))
    rank = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "text_hash")
    first = stored(named.groupBy("component").agg(F.min(rank).alias("first")).select("component", F.col("first.doc_id").alias("keep_id"), F.col("first.text_hash").alias("keep_hash")))
    other = ~F.col("doc_id").eqNullSafe(F.col("keep_id")) | (F.col("text_hash") != F.col("keep_hash"))
    gone = stored(named.join(first, "component").filter(other).select(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).distinct())
    side = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone  # 16 bytes a row
    hashed = F.xxhash64(docs["text"])
    kept = docs.join(side, docs["doc_id"].eqNullSafe(F.col("_gone_id")) & (hashed == F.col("_gone_hash")), "left_anti")
    repeated = named.groupBy("doc_id", "text_hash").count().filter("count > 1").select(F.col("doc_id").alias("_again_id"), F.col("text_hash").alias("_again_hash"))
    repeated = stored(repeated)
    if repeated.isEmpty():
        return kept
    same = kept["doc_id"].eqNullSafe(F.col("_again_id")) & (F.xxhash64(kept["text"]) == F.col("_again_hash"))
    return kept.join(repeated, same, "left_anti").unionByName(kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op4(docs: DataFrame) -> DataFrame:
    """:func:`join`, over all documents; an empty table has no row."""
    return join(docs)
