"""Exact n-gram Jaccard join by token groups.

Two texts link when their shingle sets agree to at least THRESHOLD percent (Jaccard).  Equal sets are one set.

Candidates.  With all shingles in one global order, two linked sets share a shingle among the first
n - ceil(t n) + 1 of each (t: the threshold), and they share at least
    ceil(t / (1 + t) (n1 + n2)) - max(n1 - p1, n2 - p2)
of those prefixes.  The order is by hash, with very frequent shingles last; a shingle that only one set holds is
skipped.  Both properties come from exact counts over all texts (of the lower part of the hash range, which
holds the prefixes) and reach the tasks as bit filters of fixed size.

Token-group matrix.  Similar sets (one first prefix shingle, sizes within a quarter) are a group.  The rows (shingle, group) hold
the union of the prefix shingles of a group's members, with their sizes.  Joined with a query set's
prefix and counted, they bound what it shares with any member of the group; a group whose bound is below what
a member of its sizes needs stays closed.  The members of open groups are compared with the query exactly.
A group has at most as many members as the list of its first shingle, at most `short_list`; where that list
may be longer the set is a group of its own.

Long lists.  The sets of a list longer than `short_list` (a passage that many texts share, or a large family of near
copies) are first compared with the list's first set, which the lists of one family have in common, so a pair is
compared once however many shingles it shares.  A list whose sets are then all connected is done.  The sets of the others
are dealt into blocks bounded in sets and in shingles, and pairs of blocks are tasks, each with a matrix of its own.  A task puts similar
sets of a block into groups and keeps each group's token union as a column of a token x group matrix.  The
product with a query set's tokens bounds its overlap with every member; only groups whose bound
reaches t n are opened and compared member by member.  A task returns links that span what it found
connected, at most one for each set, not all pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.graph import bit_filter, components, is_set, written

THRESHOLD, WORDS = 80, 5
#: Share of the hash range in which shingles are counted.
COUNTED = int(0.35 * 2**64)
GROUP = 16
#: Tokens of a matrix that are held as numbers at once.
COLUMNS = 4096


def set_key(tokens: np.ndarray) -> bytes:
    """A 128-bit digest of a set's sorted tokens: the name of equal sets."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def low(keys) -> np.ndarray:
    """The first 64 bits of digests."""
    return np.frombuffer(b"".join(k[:8] for k in keys), np.int64)


def prefix_size(n):
    return n - -(-THRESHOLD * n // 100) + 1


def linked(shared, n1, n2):
    return 100 * shared >= THRESHOLD * (n1 + n2 - shared)


def group_key(token: int, n: int) -> int:
    """The group of a set by its first prefix shingle and its size."""
    size = np.uint64(math.log(n) / math.log(1.25))
    return int(tn.mix(tn.mix(np.array([token], np.uint64)) + size).view(np.int64)[0])


def least_bound(n, lo, hi):
    """The fewest prefix shingles that a set of n shingles shares with a linked one of lo to hi.

    What a size needs rises up to n and falls beyond it, so an end of the range needs least.
    """
    t = THRESHOLD / 100
    ends = F.greatest(lo, n * t), F.least(hi, n / t)
    return F.least(*((n + e) * (t / (1 + t)) - t * F.greatest(n, e) for e in ends)) - F.lit(1e-6)


def matrix_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span every connection between the sets of `left` and those of `right` (positions in `sets`).

    Token-group matrix: right sets in groups of GROUP similar ones, bounded by their token unions.  The token axis is
    taken in runs of COLUMNS.  known: numbers of what the sets are connected with already; no link is returned inside one.
    """
    if not len(left) or not len(right):
        return []
    n = np.array([len(s) for s in sets])
    tokens, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), n)
    # Tokens of one set alone add to no overlap.
    held = np.bincount(inverse, minlength=len(tokens))
    new = np.cumsum(held > 1) - 1
    keep = held[inverse] > 1
    owner, token = owner[keep], new[inverse[keep]]
    if not len(token):
        return []
    # Similar sets are neighbours in the order of their smallest shared tokens.
    least = np.full(len(sets), len(tokens))
    np.minimum.at(least, owner, token)
    right = right[np.lexsort((n[right], least[right]))]
    groups = [right[i : i + GROUP] for i in range(0, len(right), GROUP)]
    order = np.argsort(token, kind="stable")
    owner, token = owner[order], token[order]
    cuts = np.searchsorted(token, np.arange(0, int(token[-1]) + 1 + COLUMNS, COLUMNS))

    def columns():
        for i in range(len(cuts) - 1):
            own = np.zeros((len(sets), COLUMNS), np.float32)
            own[owner[cuts[i] : cuts[i + 1]], token[cuts[i] : cuts[i + 1]] - i * COLUMNS] = 1
            yield own

    bound = np.zeros((len(left), len(groups)), np.float32)
    for own in columns():
        bound += own[left] @ np.stack([own[g].max(axis=0) for g in groups]).T
    opened = 100 * bound >= THRESHOLD * n[left][:, None]
    picked = np.flatnonzero(opened.any(axis=0)).tolist()
    shared = {g: np.zeros((int(opened[:, g].sum()), len(groups[g])), np.float32) for g in picked}
    for own in columns():
        for g in picked:
            shared[g] += own[left[opened[:, g]]] @ own[groups[g]].T
    root = np.arange(len(sets)) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for g in picked:
        rows = left[opened[:, g]]
        hit = linked(shared[g], n[rows][:, None], n[groups[g]][None, :])
        for i, j in zip(*np.nonzero(hit), strict=True):
            x, y = int(rows[i]), int(groups[g][j])
            rx, ry = find(x), find(y)
            if rx != ry:
                root[rx] = ry
                out.append((x, y))
    return out


def _sets(batches, column: int):
    for part in tn.slices(batches, "_text"):
        yield part, tn.shingle_sets(part.column(column), WORDS)


def shingle_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows id, n, key: size and key of every text's set; key is null for an empty set."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"))

    def task(batches):
        for part, sets in _sets(batches, 1):
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) if len(s) else None for s in sets], pa.binary())], names=["id", "n", "key"]
            )

    return source.mapInArrow(task, "id long, n long, key binary")


def _order_filters(source: DataFrame, total: int, often: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit filters of the counted shingles that more than one text, and that more than `often` texts hold."""
    buckets = max(64, total * 8 // 3 >> 26)
    width = COUNTED // buckets + 1

    def count_task(batches):
        for _, sets in _sets(batches, 0):
            distinct = {s.tobytes(): s for s in sets if len(s)}
            if not distinct:
                continue
            u, n = np.unique(np.concatenate([s[: np.searchsorted(s, tn.U64(COUNTED))] for s in distinct.values()]), return_counts=True)
            cut = np.searchsorted(u, np.arange(buckets + 1, dtype=np.uint64) * tn.U64(width))
            n = np.minimum(n, 60_000).astype(np.uint16)
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(full), "tokens": tn.binary([u[cut[b] : cut[b + 1]].tobytes() for b in full]), "n": tn.binary([n[cut[b] : cut[b + 1]].tobytes() for b in full]),
            })

    def sum_task(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()])
        n = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("n").to_pylist()]).astype(np.int64)
        order = np.argsort(tokens)
        tokens, n = tokens[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
        count = np.add.reduceat(n, first)
        many = count > 1
        return pa.table({"token": pa.array(tokens[first][many].view(np.int64)), "often": pa.array(count[many] > often)})

    counted = written(source.mapInArrow(count_task, "bucket long, tokens binary, n binary").groupBy("bucket").applyInArrow(sum_task, "token long, often boolean"), "counts")
    return bit_filter(counted, "token", bits), bit_filter(counted.where("often"), "token", bits)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", short_list: int = 64, block_sets: int = 1024, block_tokens: int = 1 << 20, filter_bits: int = 25) -> DataFrame:
    """One row per text: id, n_shingles (long), component_id (smallest id reachable by links, its own included).

    Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased.  A set holds the distinct 5-word shingles;
    fewer words are one shingle; null and empty texts have none, link with nothing and are their own component.
    Rows of one id share a component; a row whose id is null gets a null component.  Other columns are dropped.
    """
    spark = docs.sparkSession
    tn.ship_code(spark)
    table = written(shingle_table(docs, id_col, text_col), "sets")
    known = table.where("key is not null and id is not null")
    total = known.agg(F.sum("n")).first()[0] or 0
    source = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("id"))
    shared_bits, often_bits = (spark.sparkContext.broadcast(x) for x in _order_filters(source.select("_text"), total, short_list, filter_bits))

    def entry_task(batches):
        for _, sets in _sets(batches, 0):
            sets = list({s.tobytes(): s for s in sets if len(s)}.values())
            if not sets:
                continue
            flat = np.concatenate(sets)
            often, shared = is_set(often_bits.value, flat), is_set(shared_bits.value, flat) | (flat >= tn.U64(COUNTED))
            tokens, keys, counts, sizes, groups, at = [], [], [], [], [], 0
            for s in sets:
                o, w = often[at : at + len(s)], shared[at : at + len(s)]
                at += len(s)
                p = prefix_size(len(s))
                order = np.concatenate((np.flatnonzero(~o)[:p], np.flatnonzero(o)[:p]))[:p]
                order = order[w[order]]
                if len(order):
                    key = set_key(s)
                    # Counted and not in the filter: at most short_list sets hold it.
                    grouped = s[order[0]] < tn.U64(COUNTED) and not o[order[0]]
                    tokens.append(s[order])
                    keys.append(key)
                    counts.append(len(order))
                    sizes.append(len(s))
                    groups.append(group_key(int(s[order[0]]), len(s)) if grouped else int.from_bytes(key[:8], "little", signed=True))
            if tokens:
                which = np.repeat(np.arange(len(keys)), counts)
                yield pa.RecordBatch.from_pydict({
                    "token": pa.array(np.concatenate(tokens).view(np.int64)), "key": pa.array(keys, pa.binary()).take(pa.array(which)), "n": pa.array(np.array(sizes)[which]), "g": pa.array(np.array(groups, np.int64)[which]),
                })

    entries = written(source.select("_text").mapInArrow(entry_task, "token long, key binary, n long, g long").distinct(), "entries")
    lists = entries.groupBy("token").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = written(entries.join(lists, "token"), "lists")
    short = sized.where(F.col("size") <= short_list).select("token", "key", "n", "g").repartition("token")
    matrix = short.groupBy("token", F.col("g").alias("group")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count(F.lit(1)).alias("members"))
    # A pair is found from the set of the smaller group.
    met = short.join(matrix, "token").where(
        f"g <= group and (g < group or members > 1) and 100 * hi >= {THRESHOLD} * n and 100 * n >= {THRESHOLD} * lo"
    )
    bounds = met.groupBy("key", "n", "g", "group").agg(F.count(F.lit(1)).alias("bound"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    opened = bounds.where(F.col("bound") >= least_bound(F.col("n"), F.col("lo"), F.col("hi"))).select(F.col("key").alias("x"), F.col("n").alias("nx"), "g", "group")
    members = entries.select(F.col("g").alias("group"), F.col("key").alias("y"), F.col("n").alias("ny")).distinct()
    long = sized.where(F.col("size") > short_list)
    # A long list's sets are first compared with its first set.
    head = long.groupBy("token").agg(F.min(F.struct("key", "n")).alias("h")).select("token", F.col("h.key").alias("y"), F.col("h.n").alias("ny"))
    star = long.join(head, "token").where(f"key <> y and 100 * least(n, ny) >= {THRESHOLD} * greatest(n, ny)").select(F.col("key").alias("x"), "y")
    pairs = written(
        opened.join(members, "group").where(f"(g < group or x < y) and 100 * least(nx, ny) >= {THRESHOLD} * greatest(nx, ny)").select("x", "y").unionByName(star).distinct(), "pairs",
    )

    # Token sets of the sets to compare, each from the text with the smallest id that has it.
    wanted = pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key"))).unionByName(long.select("key")).distinct()
    first = known.groupBy("key").agg(F.min("id").alias("id"))

    def hash_task(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array(pair_hash(low(batch.column(0).to_pylist()), batch.column(1).to_numpy()).view(np.int64))})

    marks = wanted.join(first, "key").select("key", "id").mapInArrow(hash_task, "h long")
    chosen = spark.sparkContext.broadcast(bit_filter(marks, "h", filter_bits))

    def token_task(batches):
        for part, sets in _sets(batches, 0):
            ids = part.column(1).to_pylist()
            keys, own, tokens = [], [], []
            for i, s in zip(ids, sets, strict=True):
                if len(s):
                    keys.append(set_key(s))
                    own.append(i)
                    tokens.append(s)
            if not keys:
                continue
            hit = is_set(chosen.value, pair_hash(low(keys), np.array(own)))
            pick = np.flatnonzero(hit).tolist()
            yield pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in pick], pa.binary()), "tokens": tn.binary([tokens[i].tobytes() for i in pick])})

    tokens = written(source.mapInArrow(token_task, "key binary, tokens binary").groupBy("key").agg(F.first("tokens").alias("tokens")), "tokens")

    def compare_task(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            hit = []
            for s, t in zip(a, b, strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                hit.append(linked(len(np.intersect1d(s, t, assume_unique=True)), len(s), len(t)))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(hit)), batch.column(1).filter(pa.array(hit))], names=["a", "b"])

    with_x = pairs.join(tokens.select(F.col("key").alias("x"), F.col("tokens").alias("tx")), "x")
    near = with_x.join(tokens.select(F.col("key").alias("y"), F.col("tokens").alias("ty")), "y").select("x", "y", "tx", "ty").mapInArrow(compare_task, "a binary, b binary")
    rep = lambda name: first.select(F.col("key").alias(name), F.col("id").alias(f"{name}_id"))
    by_id = lambda links: links.join(rep("a"), "a").join(rep("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    so_far = written(components(by_id(near)), "components")

    # Lists whose sets are not all connected yet.
    # One row for each set with its long lists (at most its prefix) meets the components.
    held = long.groupBy("key", "n").agg(F.collect_list(F.struct("token", "size")).alias("_lists"))
    placed = held.join(first, "key").join(so_far, "id", "left").select("key", "n", F.coalesce("component", "id").alias("component"), F.inline("_lists"))
    per_list = placed.groupBy("token").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.sum("n").alias("_tokens"))
    blocks = F.greatest(F.ceil(F.col("size") / block_sets), F.ceil(F.col("_tokens") / block_tokens)).cast("long")
    dealt = placed.join(per_list.where("_lo <> _hi"), "token").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    # Block b of a list meets every block: it is the left or the right one of each pair it is in.
    tasks = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "token", "key", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def matrix_task(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        sets, keys, block, known = [sets[i] for i in order], [keys[i] for i in order], table.column("block").to_numpy()[order], table.column("component").to_numpy()[order]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        found = matrix_links(sets, np.flatnonzero(block == i), np.flatnonzero(block == j), known)
        return pa.table({"a": pa.array([keys[a] for a, _ in found], pa.binary()), "b": pa.array([keys[b] for _, b in found], pa.binary())})

    family = tasks.join(tokens, "key").groupBy("token", "i", "j").applyInArrow(matrix_task, "a binary, b binary")
    links = by_id(family.distinct()).unionByName(so_far.select(F.col("id").alias("a"), F.col("component").alias("b")))
    # Rows of one id are one text's versions: they are linked through their id.
    again = known.join(first.withColumnRenamed("id", "rep"), "key").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(again))
    return (
        table.join(found.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of `docs` whose id is the smallest of its component; rows with a null id stay.

    Rows that repeat one id are versions of one document and stay or go together.  Ids are whole numbers.
    """
    found = join(docs, id_col=id_col, text_col=text_col, **options)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    return docs.join(gone.hint("shuffle_hash"), id_col, "left_anti")


def pair_hash(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    return tn.mix(tn.mix(key.astype(np.int64).view(np.uint64)) + own.astype(np.int64).view(np.uint64))


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: Sets of shingles, pairs that share at least one, and what is reachable from each document.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
rare AS (SELECT s, doc_id FROM s WHERE s IN (SELECT s FROM s GROUP BY 1 HAVING count(*) > 1)),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1) m USING (doc_id)
"""
