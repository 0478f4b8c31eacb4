"""Grouping of spelling variants: words one edit apart, each tied to a far more frequent one.

Letters are hashed to a few symbols, so a word becomes a reduced word.  Words one edit apart have reduced words that are
equal or one edit apart, so it is enough to

1. generate, for every word, the full one-edit neighbourhood of its reduced word (itself, every deletion, every replacement and
   every insertion of a symbol) as 64-bit codes,
2. join these codes with the codes of the reduced vocabulary,
3. verify each pair on the original strings.

A neighbourhood has about 2 x length x symbols codes, instead of 2 x length x letters, and most name no reduced word at all: a bit filter of the
vocabulary's codes drops them where they are generated.  How many symbols there are follows from the number of words,
so that few unrelated words share a reduced word at any size of vocabulary.

Each word then takes the most frequent near word as its form, if that is FACTOR times as frequent, and forms are followed to their
roots by pointer doubling; counts rise at every step, so there are no cycles.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.graph import bit_filter, is_set, written

#: Letters of a word at least, occurrences at least, and how much more frequent a form is.
LETTERS, OCCURRENCES, FACTOR = 7, 2, 10
#: One distinct run of a document in so many loses a letter.
NOISE = 31
#: Distinct words that a task counts before it passes them on.
HELD_WORDS = 200_000
#: Letters handled at once when neighbourhoods are generated.
SLICE_LETTERS = 1 << 16
_BASE = 0x9E3779B97F4A7C15


def words_of(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, occurrences: int = OCCURRENCES, noise: int = NOISE) -> DataFrame:
    """Rows word, n: lower-cased (A-Z) maximal runs `[A-Za-z\\u00C0-\\u00FF]+` of at least `letters` code points after the deletion, and how often each occurs.

    A run loses one letter if `noise` divides the crc32 of `<id>:<run>`, the one at that number modulo its length.  A null id is written `null`;
    a null text has no runs.
    """
    tn.ship_code(docs.sparkSession)
    run = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % letters)

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    def task(batches):
        counts = Counter()
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                # bytes.lower() lowers A-Z alone, and U+00C0 to U+00FF are the two-byte sequences that begin with C3.
                own = Counter(run.findall(text.as_buffer().to_pybytes().lower()))
                start = zlib.crc32(f"{'null' if i is None else i}:".encode())
                for w, n in own.items():
                    h = zlib.crc32(w, start)
                    if h % noise == 0:
                        w = w.decode()
                        at = h % len(w)
                        if len(w) <= letters:
                            continue
                        w = (w[:at] + w[at + 1 :]).encode()
                    counts[w] += n
                if len(counts) > HELD_WORDS:
                    yield batch_of(counts)
                    counts = Counter()
        if counts:
            yield batch_of(counts)

    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(task, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def symbols_for(words: int) -> int:
    """Symbols of the reduced alphabet: half as many again as give `words` reduced words of the shortest length, 4 at least."""
    return max(4, int(np.ceil(1.5 * max(words, 1) ** (1 / LETTERS))))


class Reduced:
    """Equally long words over the reduced alphabet and the codes of what one edit makes of them.

    A code is a polynomial over the symbols modulo 2**64, put through a mixer: equal reduced words have equal codes.
    """

    def __init__(self, words: np.ndarray, symbols: int):
        n, self.length = words.shape
        self.symbols = symbols
        # Letters are dealt to symbols by a hash of the letter.
        self.s = tn.mix(words.astype(np.uint64) * tn.U64(_BASE)) % tn.U64(symbols) + tn.U64(1)
        self.power = np.ones(self.length + 2, np.uint64)
        np.multiply.accumulate(np.full(self.length + 1, _BASE, np.uint64), out=self.power[1:])
        self.before = np.zeros((n, self.length + 1), np.uint64)
        for i in range(self.length):
            self.before[:, i + 1] = self.before[:, i] * tn.U64(_BASE) + self.s[:, i]
        self.whole = self.before[:, -1]
        # The code of what follows position i.
        self.after = self.whole[:, None] - self.before * self.power[self.length :: -1][: self.length + 1]

    def codes(self) -> np.ndarray:
        return tn.mix(self.whole)

    def neighbourhood(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """One row a word: its own code and those of all deletions and replacements of, and insertions before, the symbols first to last - 1
        (all symbols and the end, if last is None); some codes come twice."""
        n, m, p = len(self.s), self.length, self.power
        stop, gaps = (m, m + 1) if last is None else (min(last, m), last)
        letter = np.arange(1, self.symbols + 1).astype(np.uint64)
        at, gap = np.arange(first, stop), np.arange(first, gaps)
        deleted = self.before[:, at] * p[m - 1 - at] + self.after[:, at + 1]
        replaced = self.whole[:, None, None] + (letter - self.s[:, at, None]) * p[m - 1 - at][None, :, None]
        inserted = (self.before[:, gap] * p[m + 1 - gap] + self.after[:, gap])[:, :, None] + letter * p[m - gap][None, :, None]
        return tn.mix(np.concatenate((self.whole[:, None], deleted, replaced.reshape(n, -1), inserted.reshape(n, -1)), axis=1))


def _by_length(column: pa.Array):
    """(positions, code points as a matrix) for runs of equally long words of a string column."""
    # Four bytes a code point.
    wide = [x.encode("utf-32-le") for x in column.to_pylist()]
    size = np.array([len(x) // 4 for x in wide])
    for m in np.unique(size).tolist():
        at = np.flatnonzero(size == m)
        step = max(1, SLICE_LETTERS // max(1, m))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            yield own, np.frombuffer(b"".join(wide[i] for i in own.tolist()), np.uint32).reshape(len(own), m)


def _coded(words: DataFrame, symbols: int) -> DataFrame:
    """word, n, the code of the reduced word and a number of the word (a written table, which fixes the number)."""

    def task(batches):
        for batch in batches:
            code = np.zeros(batch.num_rows, np.uint64)
            for at, points in _by_length(batch.column(0)):
                code[at] = Reduced(points, symbols).codes()
            yield batch.append_column("code", pa.array(code.view(np.int64)))

    return written(words.select("word", "n").mapInArrow(task, "word string, n long, code long").withColumn("number", F.monotonically_increasing_id()), "vocabulary")


def near_words(words: DataFrame, symbols: int | None = None, filter_bits: int | None = None) -> DataFrame:
    """Rows word, n, near, near_n: every ordered pair of words exactly one inserted, deleted or replaced code point apart (a written table).

    `words` has distinct words with their counts; it is read several times, so it should be a written table.  Words travel by their numbers until
    they are verified, so a very long word is not copied for each of its codes.
    """
    spark = words.sparkSession
    tn.ship_code(spark)
    size = words.count()
    symbols = symbols or symbols_for(size)
    # 16 bits for each code up to 32 MB; beyond that more codes without a word pass, and the join drops them.
    filter_bits = filter_bits or min(28, max(16, (16 * size).bit_length()))
    vocabulary = _coded(words, symbols)
    sent = spark.sparkContext.broadcast(bit_filter(vocabulary, "code", filter_bits))

    def task(batches):
        for batch in batches:
            number = batch.column(1).to_numpy()
            for at, points in _by_length(batch.column(0)):
                reduced = Reduced(points, symbols)
                row, code = [], []
                step = max(1, SLICE_LETTERS // len(at))
                for first in range(0, reduced.length + 1, step):
                    codes = reduced.neighbourhood(first, min(first + step, reduced.length + 1))
                    known = is_set(sent.value, codes.reshape(-1)).reshape(codes.shape)
                    row.append(np.repeat(at, known.sum(axis=1)))
                    code.append(codes[known].view(np.int64))
                row, code = np.concatenate(row), np.concatenate(code)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (code[1:] != code[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(number[row[new]]), pa.array(code[new])], names=["number", "code"])

    asked = vocabulary.select("word", "number").mapInArrow(task, "number long, code long")
    pairs = asked.join(vocabulary.select("code", F.col("number").alias("other")), "code").where("number <> other").select("number", "other")
    own = vocabulary.select("number", "word", "n")
    other = vocabulary.select(F.col("number").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Merge joins: a pair is small, and so looks the vocabulary to the planner, but one word may be as long as a text.
    found = pairs.join(own.hint("merge"), "number").join(other.hint("merge"), "other")
    return written(found.where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n"), "near")


def variants(words: DataFrame, *, factor: int = FACTOR, **options) -> DataFrame:
    """Rows word, form, root, n, n_near, form_n for every word of (word, n).

    form: the most frequent near word (ties: the smallest in code-point order), if it is `factor` times as frequent; else null, as form_n.
    root: where the forms lead from the word, itself if it has none.
    """
    best = (
        near_words(words, **options).groupBy("word")
        .agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"), F.first("n").alias("own"))
        .select("word", "n_near", F.when(-F.col("best.less") >= factor * F.col("own"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("to"))
    )
    best = written(best.select("word", "n_near", "to.form", "to.form_n"), "forms")
    # Only words with a form take part; each round doubles the steps taken.
    roots = best.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = written(roots.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = roots.where("moved").limit(1).count()
        roots = roots.select("word", "root")
        if not moved:
            break
    return words.join(best, "word", "left").join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", factor: int = FACTOR, **options) -> DataFrame:
    """The variants of the words of `docs`.  Repeated rows count as often as they occur; other columns are dropped; no rows give no words."""
    return variants(written(words_of(docs, id_col=id_col, text_col=text_col, **options), "words"), factor=factor)


def query(spark, sf_dir: str) -> DataFrame:
    return group(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


_TABLE_STEPS = "\n".join(f"t{k + 1} AS (SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END AS c FROM t{k})," for k in range(8))
ORACLE = rf"""
WITH RECURSIVE
t0 AS (SELECT i, i AS c FROM range(256) r(i)),
{_TABLE_STEPS}
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM t8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
own AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= {LETTERS} GROUP BY ALL),
hexed AS (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM own),
hashed AS (
  SELECT run, n, xor(4294967295::BIGINT, list_reduce(list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295::BIGINT)) AS h
  FROM hexed, crc),
cut AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= {LETTERS} GROUP BY word HAVING sum(n) >= {OCCURRENCES}),
short AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM short a JOIN short b ON a.less = b.less AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM short a JOIN words b ON a.less = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM short a JOIN words b ON a.less = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS form, max(near_n) AS form_n, any_value(n) AS n FROM near GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= {FACTOR} * w.n THEN b.form END AS form, CASE WHEN b.form_n >= {FACTOR} * w.n THEN b.form_n END AS form_n FROM words w LEFT JOIN best b USING (word)),
steps AS (SELECT word, word AS root FROM formed UNION ALL SELECT s.word, f.form FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.root FROM steps s JOIN formed f ON f.word = s.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN roots USING (word)
"""
