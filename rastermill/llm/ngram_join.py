"""N-gram Jaccard join: exact set similarity over whole texts by a prefix-tree join.

Words are what lies between ASCII white space after A-Z are lower-cased; a text's set holds the 64-bit hashes of its
distinct n-word shingles (a text of fewer words: its whole sequence). Two rows link when 100 * |x & y| >= t * |x | y|.

1. Of each set, the 2d + 1 smallest hashes travel, d being how many elements a linked set may lack. Linked sets share
   at least max(1, d) of these, so a row with fewer shared ones is alone. Chunks send each key once, as packed blobs.
2. Rows that are left are read again; equal sets become one class. Element frequencies over the classes give the global
   order, rarest first; classes that share an element of their d + 1 first ones fall into one candidate cluster.
3. A cluster is cut into blocks of bounded bytes by size band and hash; each pair of blocks that can hold links is one
   row. Within it the sets of one block stand in a compressed trie (common elements first), and each set of the other
   walks it level by level: a shared path's overlap is counted once, and a subtree goes when its overlap and the lengths
   that remain can't reach the threshold. Only a spanning forest of the links leaves the task.
4. Connected components over classes; copies join their class again.

Joins that carry texts or sets are sort-merge joins at every size, so that their plan doesn't change with the input.

Defined cases: null or white-space texts have the empty set, n_shingles 0, and link with nothing; repeated rows are
rows of their own and link as copies; a null id takes part and never becomes a component's id unless all ids there are
null; an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastermill.llm.shared import U64, by_bucket, by_bytes, components, forest, mix, partitions, release, saved, split_words, stable_rows

ALONE = np.uint32(0xFFFFFFFF)
STEP = U64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 128 << 10
SALTS = 64


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, distinct, offsets = split_words(texts)
    words = np.array([xxhash.xxh64_intdigest(w) for w in distinct], U64)[codes]
    rolled = np.full(max(0, len(words) - n + 1), U64(n))
    for k in range(n):
        rolled = mix(rolled * STEP + words[k : k + len(rolled)])
    sets = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            sets.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], U64)
            for k in range(a, b):
                h = mix(h * STEP + words[k : k + 1])
            sets.append(h)
        else:
            sets.append(np.empty(0, U64))
    return sets


def lacking(sizes: np.ndarray | int, t: int):
    """How many elements of a set of this size a linked set may lack."""
    return sizes - -(-t * sizes // 100)


# --- step 1: which rows can have a link at all

_SENT = "bucket int, chunk long, k binary, o binary, x binary, ids array<bigint>"


def _send_prefixes(n: int, t: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rids, ids, sizes, keys, owners, known, held = [], [], [], [], [], {}, 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rids, ids, sizes, keys, owners, known, held
            if not rids:
                return
            chunk, size = rids[0], np.array(sizes, np.int64)
            need = np.maximum(1, lacking(size, t))
            need[size == 0] = 1 << 30
            base = np.zeros(len(rids), np.int64)
            copied = np.array([known[h][1] if h else 0 for h in hashes], bool)
            base[copied] = need[copied]  # a copy of it is in this chunk
            k = np.concatenate(keys) if keys else np.empty(0, U64)
            o = np.concatenate(owners) if owners else np.empty(0, np.uint32)
            order = np.argsort(k, kind="stable")
            k, o = k[order], o[order]
            first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
            runs = np.diff(np.r_[first, len(k)])
            np.add.at(base, o[np.repeat(runs > 1, runs)], 1)
            k, o = k[first], np.where(runs > 1, ALONE, o[first])
            rows = [(-1, chunk, np.array(rids, np.int64).tobytes(), np.minimum(need, 1 << 30).astype(np.uint32).tobytes(), np.concatenate([base, size]).astype(np.uint32).tobytes(), ids)]
            rows += [(b, chunk, k[at].tobytes(), o[at].astype(np.uint32).tobytes(), None, None) for b, at in by_bucket(k, buckets)]
            for at in range(0, len(rows), 256):
                yield _rows(rows[at : at + 256])
            rids, ids, sizes, keys, owners, known, held = [], [], [], [], [], {}, 0
            hashes.clear()

        hashes: list = []
        for batch in by_bytes(batches, "text"):
            for rid, doc, s in zip(batch.column("rid").to_pylist(), batch.column("id").to_pylist(), shingle_sets(batch.column("text"), n), strict=True):
                mine = len(rids)
                rids.append(rid)
                ids.append(doc)
                sizes.append(len(s))
                h = xxhash.xxh128_digest(s.tobytes()) if len(s) else None
                hashes.append(h)
                if h is None:
                    continue
                if h in known:
                    known[h][1] = True
                    continue
                known[h] = [mine, False]
                d = lacking(len(s), t)
                p = s[: d + max(1, d)]
                keys.append(p)
                owners.append(np.full(len(p), mine, np.uint32))
                held += len(p)
            if held > 1 << 20 or len(rids) > 1 << 16:
                yield from flush()
        yield from flush()
        release()

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "chunk", "k", "o", "x", "ids"])


def _u(blob: pa.Scalar | bytes, kind) -> np.ndarray:
    return np.frombuffer(blob, kind)


_REPLY = "chunk long, o binary, x binary"


def _shared_elsewhere(table: pa.Table) -> pa.Table:
    chunks, k, o = table.column("chunk").to_pylist(), [_u(b, U64) for b in table.column("k").to_pylist()], [_u(b, np.uint32) for b in table.column("o").to_pylist()]
    _, back, seen = np.unique(np.concatenate(k), return_inverse=True, return_counts=True)
    many = seen[back] > 1
    out, at = [], 0
    for chunk, mine in zip(chunks, o, strict=True):
        hit = mine[many[at : at + len(mine)] & (mine != ALONE)]
        at += len(mine)
        if len(hit):
            who, times = np.unique(hit, return_counts=True)
            out.append((chunk, who.astype(np.uint32).tobytes(), times.astype(np.uint32).tobytes()))
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()), "o": pa.array([r[1] for r in out], pa.binary()), "x": pa.array([r[2] for r in out], pa.binary())})


_JUDGED = "rid long, id long, n_shingles long, survives boolean"


def _judge(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = next(r for r in rows if r["k"] is not None)
    rids, need = _u(head["k"], np.int64), _u(head["o"], np.uint32)
    both = _u(head["x"], np.uint32).astype(np.int64)
    total, sizes = both[: len(rids)].copy(), both[len(rids) :]
    for r in rows:
        if r["k"] is None:
            total[_u(r["o"], np.uint32)] += _u(r["x"], np.uint32)
    return pa.table({"rid": pa.array(rids), "id": pa.array(head["ids"], pa.int64()), "n_shingles": pa.array(sizes), "survives": pa.array(total >= need)})


# --- step 2: classes, global order, candidate clusters


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in by_bytes(batches, "text"):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), n)]
            classes = [xxhash.xxh128_digest(s) for s in sets]
            blobs = [None if c in seen or seen.add(c) else s for c, s in zip(classes, sets, strict=True)]
            if len(seen) > 1 << 20:
                seen.clear()
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("id"), pa.array(classes, pa.binary()), pa.array(blobs, pa.binary())], names=["rid", "id", "class", "tokens"])
        release()

    return run


def _send_counts(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        k, c = np.unique(np.concatenate([_u(b, U64) for b in table.column("tokens").to_pylist()]), return_counts=True)
        chunk = table.column("chunk")[0].as_py()
        rows = [(b, chunk, k[at].tobytes(), c[at].astype(np.uint32).tobytes()) for b, at in by_bucket(k, buckets)]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int32()), "k": pa.array([r[2] for r in rows], pa.binary()), "x": pa.array([r[3] for r in rows], pa.binary())})

    return run


def _sum_counts(table: pa.Table) -> pa.Table:
    k = [_u(b, U64) for b in table.column("k").to_pylist()]
    c = np.concatenate([_u(b, np.uint32) for b in table.column("x").to_pylist()])
    _, back = np.unique(np.concatenate(k), return_inverse=True)
    total = np.bincount(back, weights=c)[back]
    keys, counts, at = [], [], 0
    for mine in k:
        f = total[at : at + len(mine)]
        at += len(mine)
        keys.append(mine[f > 1].tobytes())
        counts.append(f[f > 1].astype(np.int64).tobytes())
    return pa.table({"chunk": table.column("chunk"), "k": pa.array(keys, pa.binary()), "x": pa.array(counts, pa.binary())})


def _first_elements(t: int):
    """The rarest d + 1 elements of each set, without those that no other set has."""

    def run(sets: pa.Table, replies: pa.Table) -> pa.Table:
        out_k, out_r = [np.empty(0, U64)], [np.empty(0, np.int64)]
        if sets.num_rows and replies.num_rows:
            k = np.concatenate([_u(b, U64) for b in replies.column("k").to_pylist()])
            f = np.concatenate([_u(b, np.int64) for b in replies.column("x").to_pylist()])
            order = np.argsort(k)
            k, f = k[order], f[order]
            for rid, blob in zip(sets.column("rid").to_pylist(), sets.column("tokens").to_pylist(), strict=True):
                s = _u(blob, U64)
                at = np.searchsorted(k, s)
                at[at == len(k)] = 0
                freq = np.where(k[at] == s, f[at], 1) if len(k) else np.ones(len(s), np.int64)
                first = np.lexsort((s, freq))[: lacking(len(s), t) + 1]
                first = first[freq[first] > 1]
                out_k.append(s[first])
                out_r.append(np.full(len(first), rid, np.int64))
        return pa.table({"key": pa.array(np.concatenate(out_k).view(np.int64)), "rid": pa.array(np.concatenate(out_r))})

    return run


# --- step 3: the trie


class Trie:
    """A compressed prefix tree over sorted element arrays; nodes are kept in levels for vectorised traversal."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.size = np.array([len(s) for s in sets], np.int64)
        spans, parents, levels, ends, stack = [], [], [], [], []  # stack: (node, depth at its end) along the last set's path
        before = np.empty(0, np.uint32)
        for i in order:
            s = sets[i]
            m = min(len(s), len(before))
            differ = np.flatnonzero(s[:m] != before[:m])
            common = int(differ[0]) if len(differ) else m
            while stack and (spans[stack[-1]][1]) >= common and spans[stack[-1]][1] > common:
                top = stack[-1]
                if spans[top][1] - (spans[top][2].shape[0]) >= common:
                    stack.pop()
                    continue
                # split the node at `common`: its upper part becomes the parent of both
                start = spans[top][1] - len(spans[top][2])
                whole = spans[top][2]
                upper = len(spans)
                spans.append([None, common, whole[: common - start]])
                parents.append(parents[top])
                ends.append([])
                spans[top] = [None, spans[top][1], whole[common - start :]]
                parents[top] = upper
                stack[-1] = upper
                break
            if len(s) > common or not stack:
                spans.append([None, len(s), s[common:]])
                parents.append(stack[-1] if stack else -1)
                ends.append([i])
                stack.append(len(spans) - 1)
            else:
                ends[stack[-1]].append(i)
            before = s
        count = len(spans)
        self.parent = np.array(parents, np.int64)
        self.depth = np.array([s[1] for s in spans], np.int64)
        lengths = np.array([len(s[2]) for s in spans], np.int64)
        self.start = np.r_[0, np.cumsum(lengths)]
        self.tokens = np.concatenate([s[2] for s in spans]) if spans else np.empty(0, np.uint32)
        self.last = np.array([int(s[2][-1]) if len(s[2]) else 0 for s in spans], np.int64)
        level = np.zeros(count, np.int64)
        pending = np.flatnonzero(self.parent >= 0)
        done = self.parent < 0
        while len(pending):
            ready = pending[done[self.parent[pending]]]
            level[ready] = level[self.parent[ready]] + 1
            done[ready] = True
            pending = pending[~done[pending]]
        self.children: list[list[int]] = [[] for _ in range(count)]
        for v in range(count):
            if self.parent[v] >= 0:
                self.children[self.parent[v]].append(v)
        self.roots = np.flatnonzero(self.parent < 0)
        self.child_start = np.r_[0, np.cumsum([len(c) for c in self.children])]
        self.child = np.array([v for c in self.children for v in c], np.int64)
        self.ends = ends
        self.terminal = np.array([bool(e) for e in ends], bool)
        self.least, self.most = np.full(count, 1 << 40), np.zeros(count, np.int64)
        for v in np.argsort(-level, kind="stable").tolist():
            for i in ends[v]:
                self.least[v], self.most[v] = min(self.least[v], self.size[i]), max(self.most[v], self.size[i])
            if (p := self.parent[v]) >= 0:
                self.least[p], self.most[p] = min(self.least[p], self.least[v]), max(self.most[p], self.most[v])

    def linked(self, x: np.ndarray, mark: np.ndarray, t: int) -> list[int]:
        """Which of the tree's sets link with x; mark is 1 at x's elements."""
        found: list[int] = []
        nodes, above = self.roots, np.zeros(len(self.roots), np.int64)
        while len(nodes):
            n = self.start[nodes + 1] - self.start[nodes]
            starts = np.cumsum(n) - n
            flat = np.arange(int(n.sum())) - np.repeat(starts - self.start[nodes], n)
            hits = np.concatenate([[0], np.cumsum(mark[self.tokens[flat]])])
            overlap = above + hits[starts + n] - hits[starts]
            for j in np.flatnonzero(self.terminal[nodes]).tolist():
                for i in self.ends[nodes[j]]:
                    if overlap[j] * (100 + t) >= t * (len(x) + self.size[i]):
                        found.append(i)
            rest = np.minimum(len(x) - np.searchsorted(x, self.last[nodes], side="right"), self.most[nodes] - self.depth[nodes])
            live = (overlap + rest) * (100 + t) >= t * (len(x) + self.least[nodes])
            nodes, above = nodes[live], overlap[live]
            n = self.child_start[nodes + 1] - self.child_start[nodes]
            starts = np.cumsum(n) - n
            flat = np.arange(int(n.sum())) - np.repeat(starts - self.child_start[nodes], n)
            nodes, above = self.child[flat], np.repeat(above, n)
        return found


def block_links(a: list[tuple[int, bytes]], b: list[tuple[int, bytes]] | None, t: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between blocks a and b, or within a if b is None."""
    both = [*a, *(b or [])]
    sets = [_u(s, U64) for _, s in both]
    rid = np.array([r for r, _ in both], np.int64)
    distinct, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(distinct), np.uint32)
    place[np.lexsort((distinct, -seen))] = np.arange(len(distinct), dtype=np.uint32)
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    ordered = [np.sort(x) for x in np.split(place[at], cuts)]
    base = len(a) if b else 0
    tree, mark = Trie(ordered[base:]), np.zeros(len(distinct), np.int8)
    left, right = [], []
    for i in range(len(a)):
        mark[ordered[i]] = 1
        for j in tree.linked(ordered[i], mark, t):
            if base + j != i:
                left.append(i)
                right.append(base + j)
        mark[ordered[i]] = 0
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(rid[left], rid[right])


def _join_blocks(t: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = ([(r["rid"], r["tokens"]) for r in x] if (x := batch.column(c)[i].as_py()) is not None else None for c in ("a", "b"))
                x, y = block_links(a, b, t)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def _salted(bounds: DataFrame) -> DataFrame:
    """Each row once for each salt, so that what joins with it is dealt to SALTS tasks; for tables with few, small rows."""
    return bounds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _salt(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int").alias("salt")


def _block_pairs(members: DataFrame, t: int, block_bytes: int) -> DataFrame:
    """Rows (a, b) of blocks of clusters; b is null for a block with itself. members: cluster, rid, n, tokens.

    A cluster within block_bytes is one block. Only the greater ones have rows in `cut`, by size band, so its copies by salt
    take SALTS small rows for each band of a cluster of block_bytes or more; rows without a match are in one-block clusters.
    """
    band = F.floor(F.log(F.col("n")) / F.lit(float(np.log(100 / t)) if t < 100 else 1e-9)).cast("int")
    banded = members.withColumn("band", band)
    per_band = saved(banded.groupBy("cluster", "band").agg(F.sum("n").alias("n")), "bands")
    large = per_band.groupBy("cluster").agg(F.sum("n").alias("whole")).where(F.col("whole") * 8 > block_bytes)
    cut = saved(per_band.join(large, "cluster").select("cluster", "band", F.ceil(F.col("n") * 8 / block_bytes).cast("int").alias("cuts")), "cuts")
    placed = banded.select("*", _salt("rid")).join(_salted(cut), ["cluster", "band", "salt"], "left")
    placed = placed.withColumns({"band": F.when(F.col("cuts").isNull(), F.lit(0)).otherwise(F.col("band")), "cuts": F.coalesce("cuts", F.lit(1))})
    placed = placed.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("cuts")).cast("int"))
    blocks = saved(placed.groupBy("cluster", "band", "cuts", "block").agg(F.collect_list(F.struct("rid", "tokens")).alias("sets")), "blocks")
    alone = blocks.select(F.col("sets").alias("a"), F.lit(None).cast(blocks.schema["sets"].dataType).alias("b"))
    up = _salted(cut.select("cluster", (F.col("band") - 1).alias("band"), F.col("cuts").alias("other")))
    down = _salted(cut.select("cluster", (F.col("band") + 1).alias("band"), F.col("cuts").alias("other")))
    spread, near = blocks.select("*", _salt("block")), ["cluster", "band", "salt"]
    key = ["cluster", "lo", "i", "hi", "j"]

    def side(df: DataFrame, name: str, lo, i, hi, j) -> DataFrame:
        return df.select("cluster", lo.cast("int").alias("lo"), i.cast("int").alias("i"), hi.cast("int").alias("hi"), j.cast("int").alias("j"), F.col("sets").alias(name))

    many = blocks.where("cuts > 1")
    same_a = side(many.where("block < cuts - 1").withColumn("p", F.explode(F.expr("sequence(block + 1, cuts - 1)"))), "a", F.col("band"), F.col("block"), F.col("band"), F.col("p"))
    same_b = side(many.where("block > 0").withColumn("p", F.explode(F.expr("sequence(0, block - 1)"))), "b", F.col("band"), F.col("p"), F.col("band"), F.col("block"))
    next_a = side(spread.join(up, near).withColumn("p", F.explode(F.expr("sequence(0, other - 1)"))), "a", F.col("band"), F.col("block"), F.col("band") + 1, F.col("p"))
    next_b = side(spread.join(down, near).withColumn("p", F.explode(F.expr("sequence(0, other - 1)"))), "b", F.col("band") - 1, F.col("p"), F.col("band"), F.col("block"))
    return alone.union(same_a.union(next_a).join(same_b.union(next_b), key).select("a", "b"))


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: int = 80, block_bytes: int = BLOCK_BYTES, row_col: str | None = None) -> DataFrame:
    """Links rows of `docs` and gives each its component.

    Returns row_id (that of `row_col`, unique longs that stable_rows made, else new ones), id, n_shingles, component_id (smallest id that links reach,
    its own included) and kept (true for one row of each component: smallest id, then row_id). threshold is a percentage
    from 1 to 100.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    columns = [F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")]
    base = docs.select(*columns, F.col(row_col).alias("rid")) if row_col else stable_rows(docs.select(*columns), "rid")
    sent = saved(base.mapInArrow(_send_prefixes(n, threshold, buckets), _SENT), "prefixes")
    replies = sent.where("bucket >= 0").select("bucket", "chunk", "k", "o").groupBy("bucket").applyInArrow(_shared_elsewhere, _REPLY)
    heads = sent.where("bucket < 0").select("chunk", "k", "o", "x", "ids")
    judged = saved(heads.unionByName(replies, allowMissingColumns=True).groupBy("chunk").applyInArrow(_judge, _JUDGED), "judged")

    sets = saved(base.join(judged.where("survives").select("rid").hint("merge"), "rid").select("rid", "id", "text").mapInArrow(_sets(n), "rid long, id long, class binary, tokens binary"), "sets")
    rank = F.struct(F.col("id").isNull(), F.col("id"), F.col("rid"))
    classes = saved(sets.groupBy("class").agg(F.min(F.struct(F.col("tokens").isNull(), F.col("rid")))["rid"].alias("rep"), F.min(rank).alias("best")), "classes")
    reps = saved(
        sets.join(classes.select(F.col("rep").alias("rid")).hint("merge"), "rid").select("rid", "tokens", (F.octet_length("tokens") / 8).cast("long").alias("n"), F.pmod(F.hash("rid"), F.lit(buckets)).alias("chunk")),
        "reps",
    )
    counts = reps.select("chunk", "tokens").groupBy("chunk").applyInArrow(_send_counts(buckets), "bucket int, chunk int, k binary, x binary")
    frequent = counts.groupBy("bucket").applyInArrow(_sum_counts, "chunk int, k binary, x binary")
    firsts = saved(reps.select("chunk", "rid", "tokens").groupBy("chunk").cogroup(frequent.groupBy("chunk")).applyInArrow(_first_elements(threshold), "key long, rid long"), "firsts")
    star = saved(firsts.groupBy("key").agg(F.min("rid").alias("hub")), "star")  # written, so that adaptive execution may split a hot key
    near = components(firsts.join(star.hint("merge"), "key").where("rid <> hub").select("rid", "hub"), "rid", "hub")
    members = near.withColumnsRenamed({"node": "rid", "root": "cluster"}).join(reps.select("rid", "n", "tokens").hint("merge"), "rid")
    links = saved(_block_pairs(saved(members, "members"), threshold, block_bytes).mapInArrow(_join_blocks(threshold), "a long, b long"), "found")

    roots = components(links, "a", "b")
    named = saved(classes.join(roots, F.col("rep") == F.col("node"), "left").select("class", "best", F.coalesce("root", "rep").alias("root")), "named")
    best = saved(named.groupBy("root").agg(F.min("best").alias("top")), "best")  # written, so that adaptive execution may split a hot root
    named = named.join(best.hint("merge"), "root").select("class", "top")
    own = sets.select("rid", "class").join(named, "class").select("rid", F.col("top.id").alias("least"), (F.col("top.rid") == F.col("rid")).alias("kept"))
    return judged.select("rid", "id", "n_shingles").join(own, "rid", "left").select(
        F.col("rid").alias("row_id"), "id", "n_shingles", F.when(F.col("kept").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept")
    )
