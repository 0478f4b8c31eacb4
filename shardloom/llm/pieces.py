"""SentencePiece encoding and decoding by a max-plus scan.

A text is cut into vocabulary pieces so that the sum of the piece scores is largest; a character that no
piece covers is spelled as byte pieces.  With best[j] the best sum of the first j characters,
    best[j] = max over l of best[j - l] + score(characters j - l .. j),
which is linear in the (max, +) algebra.  So a chunk of a text is a matrix from the values at the
`width` positions before it to those at its last `width` positions.  Matrices of neighbouring chunks multiply
associatively: each run of FAN chunks is multiplied pair by pair, the products of a text's runs give the values before
each run, and a run gives those before each of its chunks.  A chunk that knows them tells for each way of ending
which way of starting it goes with; these maps compose in the same two steps, backwards, to the exact end of every
chunk's part, and each chunk is then traced back alone.

Texts of at most GIANT characters are one chunk.  No piece of a vocabulary holds a space after another character (this is
checked), so every space after a non-space is a boundary that all paths share.  A chunk is cut anywhere; its matrix is that
of its head (up to its first such boundary), the sum of its middle, and the values of its tail (from its last one on).
Stretches between boundaries are solved once per task and remembered; what they give is compared with the text itself.

Scores are whole numbers, so sums are exact, the product is associative, and ties are broken the same way
(longest last piece) whichever way a text was cut.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.graph import written

SPACE, MARK = 0x20, 0x2581
LOW = -(1 << 50)
#: Texts with more characters than GIANT are cut into chunks of CHUNK characters, and those dealt into runs of FAN.
GIANT, CHUNK, FAN = 32768, 8192, 64
#: Stretches of at most SHORT bytes are solved together; a task remembers about MEMORY solved ones.
SHORT, MEMORY = 48, 400_000
#: Bytes of ordinary texts that are encoded at once.
SLICE = 1 << 20


@dataclass
class Vocabulary:
    """pieces: text of each id, or None for control and byte pieces; scores: whole numbers; byte_ids: id of each byte."""

    pieces: list[str | None]
    scores: np.ndarray
    byte_ids: np.ndarray
    byte_score: int
    width: int = field(init=False)

    def __post_init__(self):
        texts = [p for p in self.pieces if p]
        for p in texts:
            if " " in p.lstrip(" "):
                raise ValueError(f"piece {p!r} holds a space after another character")
        self.width = max([1, *map(len, texts)])
        ids = np.array([i for i, p in enumerate(self.pieces) if p], np.int64)
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        end = np.cumsum([len(p) for p in texts]).astype(np.int64)
        start = end - np.array([len(p) for p in texts], np.int64)
        self.key = tn.span_hash(code_prefix(cp), start, end) if texts else np.zeros(0, np.uint64)
        self.key_id = ids
        raw = [p.encode() if p else b"" for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            raw[i] = bytes([b])
        self.scores = self.scores.copy()
        self.scores[self.byte_ids] = self.byte_score
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_first = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)


def load(path: str) -> Vocabulary:
    """Read a model file.  A vocabulary made by merging has ranks for scores, not probabilities: a piece of
    rank r then scores -40000 - round(1000 * log(r + 2)), so the fewest pieces are taken and of those the
    likeliest by Zipf's law; log-probabilities are used as they are."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    raw = np.array([sp.get_score(i) for i in range(n)])
    pieces = [None if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i) else sp.id_to_piece(i).replace(chr(MARK), " ") for i in range(n)]
    named = {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
    if len(named) != 256:
        raise ValueError("the vocabulary has no byte pieces; texts could not be given back exactly")
    ranks = bool((raw == np.round(raw)).all())
    scores = -40000 - np.round(1000 * np.log(np.clip(-raw, 0, n) + 2)) if ranks else np.round(1000 * raw)
    scores = scores.astype(np.int64)
    return Vocabulary(pieces, scores, np.array([named[f"<0x{b:02X}>"] for b in range(256)]), int(scores.min()) - 40000)


def code_prefix(cp: np.ndarray) -> np.ndarray:
    up, _ = tn.powers(len(cp) + 1)
    out = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(tn.mix((cp.astype(np.uint64) + tn.U64(1)) * tn.U64(0x9E3779B97F4A7C15)) * up[: len(cp)], out=out[1:])
    return out


class Encoder:
    """A vocabulary with its lookup table, for the tasks of one Spark stage."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.index = tn.KeyIndex(vocabulary.key)
        self.forget()

    def forget(self) -> None:
        self.known, self.known_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.ids_first, self.ids_count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def arcs(self, cp: np.ndarray, size: np.ndarray, room: np.ndarray, low: int = LOW, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
        """Score, (characters, width), of the piece of l + 1 characters that ends with each character; prefix hashes.

        size: bytes of each character; room: how many characters may lie in it and before it.
        Where there is no piece the score is `low`; a character without a piece is spelled in bytes.
        """
        n, w = len(cp), self.v.width
        prefix = code_prefix(cp)
        score = np.full((n, w), low, kind)
        at = np.arange(n)
        for l in range(w):
            at = at[room[at] > l]
            if not len(at):
                break
            hit = self.index.find(tn.span_hash(prefix, at - l, at + 1))
            k = np.flatnonzero(hit >= 0)
            score[at[k], l] = self.v.scores[self.v.key_id[hit[k]]]
        none = score[:, 0] == low
        score[none, 0] = self.v.byte_score * size[none]
        return score, prefix

    def forward(self, score: np.ndarray, first: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best sums and longest best last pieces for sequences cut by `first`, all in step.

        entry: (sequences, width) or (sequences, width, columns): values at the width positions before
        each sequence, nearest last.  Returns the values at every sequence's last `width` positions and,
        for each character, the length of the last piece (0-based; not kept for several columns).
        """
        w = self.v.width
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
        columns = entry.ndim == 3
        window = entry[order].copy()  # a ring: position p of a sequence is in slot p % w, those before it too
        back = np.zeros(len(score), np.int8)
        lanes = np.arange(w)
        for t in range(longest):
            rows = order[: live[t]]
            at = first[rows] + t
            old = window[: len(rows)][:, (t - 1 - lanes) % w]
            cand = old + (score[at][:, :, None] if columns else score[at])
            if columns:
                window[: len(rows), t % w] = np.maximum(cand.max(axis=1), LOW)
            else:
                l = w - 1 - cand[:, ::-1].argmax(axis=1)
                back[at] = l
                window[: len(rows), t % w] = np.maximum(cand[np.arange(len(rows)), l], LOW)
        last = np.empty_like(window)
        for i, n in enumerate(size[order].tolist()):
            last[order[i]] = window[i][(n - w + lanes) % w]
        return last, back

    def forward_words(self, score: np.ndarray, first: np.ndarray) -> np.ndarray:
        """`forward` for short sequences from the origin: at character t only t + 1 lengths are possible."""
        size = np.diff(first)
        order = np.argsort(-size, kind="stable")
        longest = int(size.max(initial=0))
        live = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
        best = np.zeros((len(size), longest + 1), score.dtype)
        back = np.zeros(len(score), np.int8)
        for t in range(longest):
            n, k = live[t], min(t + 1, self.v.width)
            at = first[order[:n]] + t
            # Longest piece first, so that argmax keeps it on ties.
            cand = best[:n, t + 1 - k : t + 1] + score[at, :k][:, ::-1]
            l = cand.argmax(axis=1)
            best[:n, t + 1] = cand[np.arange(n), l]
            back[at] = k - 1 - l
        return back

    def trace(self, back: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Marks the last character of every piece on the best paths that end before character `end` of each sequence."""
        mark = np.zeros(len(back), bool)
        at = first[:-1] + end - 1
        low = first[:-1]
        live = np.flatnonzero(at >= low)
        at = at[live]
        while len(live):
            mark[at] = True
            at = at - back[at] - 1
            keep = at >= low[live]
            live, at = live[keep], at[keep]
        return mark

    def spell(self, prefix: np.ndarray, back: np.ndarray, mark: np.ndarray, buf: np.ndarray, begin: np.ndarray, size: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids in order and, for each character, how many ids end with it.

        prefix: hashes over all characters; skip: their positions, if the other arrays hold a part of them.
        """
        at = np.flatnonzero(mark)
        where = at if skip is None else skip[at]
        hit = self.index.find(tn.span_hash(prefix, where - back[at], where + 1))
        piece = np.where(hit >= 0, self.v.key_id[hit], -1)
        n = np.where(piece < 0, size[at], 1)
        first = np.concatenate(([0], np.cumsum(n)))
        out = np.repeat(piece, n)
        low = np.flatnonzero(out < 0)
        which = np.searchsorted(first, low, side="right") - 1
        out[low] = self.v.byte_ids[buf[begin[at[which]] + low - first[which]]]
        count = np.zeros(len(mark), np.int64)
        count[at] = n
        return out, count

    def encode_rows(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all rows and the rows' cuts into them (each row is one chunk)."""
        buf, off = tn.text_bytes(column)
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space = buf == SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[off[:-1][off[:-1] < len(buf)]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        h = tn.keyed_hash(buf, start, end)
        keys, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.forget()
        at = np.minimum(np.searchsorted(self.known, keys), max(len(self.known) - 1, 0))
        new = self.known[at] != keys if len(self.known) else np.ones(len(keys), bool)
        self._learn(keys[new], buf, start[pick[new]], end[pick[new]])
        at = np.searchsorted(self.known, keys)
        a = self.ids_first[self.known_at[at]][inverse]
        n = self.ids_count[self.known_at[at]][inverse]
        first = np.concatenate(([0], np.cumsum(n)))
        out = self.ids[np.arange(first[-1]) + np.repeat(a - first[:-1], n)]
        cuts = first[np.searchsorted(start, off)]
        raw, ends = self.decode(out.astype(np.int64), cuts)
        if np.array_equal(raw, buf):
            return out, cuts
        # Stretches are known by hashes: where two met, the rows are solved by their characters.
        rows = []
        for i in range(len(off) - 1):
            own = buf[off[i] : off[i + 1]]
            ids = out[cuts[i] : cuts[i + 1]]
            rows.append(ids if np.array_equal(raw[ends[i] : ends[i + 1]], own) else self.exact(own.tobytes().decode()))
        return np.concatenate(rows), np.concatenate(([0], np.cumsum([len(r) for r in rows])))

    def exact(self, text: str) -> np.ndarray:
        """The best pieces of one text, looked up as strings."""
        v = self.v
        look = {p: i for i, p in enumerate(v.pieces) if p}
        best, back = [0] + [LOW * 2] * len(text), [(0, -1)] * (len(text) + 1)
        for j in range(1, len(text) + 1):
            for l in range(1, min(j, v.width) + 1):
                i = look.get(text[j - l : j], -1)
                if i < 0 and l > 1:
                    continue
                c = best[j - l] + (int(v.scores[i]) if i >= 0 else v.byte_score * len(text[j - 1].encode()))
                if c >= best[j]:
                    best[j], back[j] = c, (l, i)
        out, j = [], len(text)
        while j:
            l, i = back[j]
            out.append([i] if i >= 0 else v.byte_ids[list(text[j - 1].encode())].tolist())
            j -= l
        return np.array([x for part in out[::-1] for x in part], np.int32)

    def _learn(self, keys: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Solve the stretches buf[start:end] and remember them."""
        parts = [(keys[p], *self._solve(buf, start[p], end[p])) for p in (np.flatnonzero(end - start <= SHORT), np.flatnonzero(end - start > SHORT)) if len(p)]
        fresh = np.concatenate([keys[:0], *(k for k, _, _ in parts)])
        for _, ids, count in parts:
            self.ids_first = np.concatenate((self.ids_first, len(self.ids) + np.concatenate(([0], np.cumsum(count)))[:-1]))
            self.ids_count = np.concatenate((self.ids_count, count))
            self.ids = np.concatenate((self.ids, ids.astype(np.int32)))
        every = np.concatenate((self.known, fresh))
        where = np.concatenate((self.known_at, np.arange(len(self.ids_count) - len(fresh), len(self.ids_count))))
        order = np.argsort(every)
        self.known, self.known_at = every[order], where[order]

    def _solve(self, buf, start, end):
        """Piece ids of stretches, one after another, and how many each has."""
        size = end - start
        first = np.concatenate(([0], np.cumsum(size)))
        own = buf[np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(start, size)]
        begin, width, cp = characters(own)
        cfirst = np.searchsorted(begin, first)
        room = np.arange(len(cp)) - np.repeat(cfirst[:-1], np.diff(cfirst)) + 1
        if size.max(initial=0) <= SHORT:
            score, prefix = self.arcs(cp, width, room, -(1 << 30), np.int32)
            back = self.forward_words(score, cfirst)
        else:
            score, prefix = self.arcs(cp, width, room)
            back = self.forward(score, cfirst, self.origin(len(start)))[1]
        mark = self.trace(back, cfirst, np.diff(cfirst))
        flat, count = self.spell(prefix, back, mark, own, begin, width)
        return flat, np.diff(np.concatenate(([0], np.cumsum(count)))[cfirst])

    def origin(self, n: int) -> np.ndarray:
        """Values before the start of a text: 0 at the start, nothing before it."""
        e = np.full((n, self.v.width), LOW, np.int64)
        e[:, -1] = 0
        return e

    def decode(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows and the rows' cuts into them."""
        a = self.v.raw_first[ids]
        n = self.v.raw_first[ids + 1] - a
        first = np.concatenate(([0], np.cumsum(n)))
        return self.v.raw[np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(a, n)], first[cuts]

    def chunks(self, texts: list[tuple[str, int]]):
        """Arcs of chunks given as (text with its halo, length of the halo), one after another."""
        w = self.v.width
        whole = "".join(t for t, _ in texts).encode()
        own = np.frombuffer(whole, np.uint8)
        begin, size, cp = characters(own)
        length = np.array([len(t) for t, _ in texts])
        halo = np.array([h for _, h in texts])
        every = np.concatenate(([0], np.cumsum(length)))
        room = np.arange(len(cp)) - np.repeat(every[:-1], length) + 1
        score, prefix = self.arcs(cp, size, np.minimum(room, w))
        inner = np.arange(len(cp)) - np.repeat(every[:-1], length) >= np.repeat(halo, length)
        first = np.concatenate(([0], np.cumsum(length - halo)))
        return score[inner], first, (prefix, own, begin[inner], size[inner], np.flatnonzero(inner))

    def matrices(self, texts: list[tuple[str, int]]) -> np.ndarray:
        """(chunks, width out, width in): best sums from each entry position to each of the last positions."""
        w = self.v.width
        score, first, _ = self.chunks(texts)
        unit = np.full((w, w), LOW, np.int64)
        np.fill_diagonal(unit, 0)
        return self.forward(score, first, np.broadcast_to(unit, (len(texts), w, w)).copy())[0]


def product(late: np.ndarray, early: np.ndarray) -> np.ndarray:
    """Max-plus products of matrices (or of stacks of them): out[i, j] = max over k of late[i, k] + early[k, j]."""
    return np.maximum((late[..., :, :, None] + early[..., None, :, :]).max(axis=-2), LOW)


def run_product(m: np.ndarray) -> np.ndarray:
    """The product of a run of matrices (first chunk first), neighbours pair by pair."""
    while len(m) > 1:
        pairs = product(m[1::2], m[: len(m) // 2 * 2 : 2])
        m = np.concatenate((pairs, m[-1:])) if len(m) % 2 else pairs
    return m[0]


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, byte length and number of every character; a literal mark gets a number that no piece has."""
    begin = np.flatnonzero((buf & 0xC0) != 0x80)
    cp = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    return begin, np.diff(np.append(begin, len(buf))), cp


def _digest(ids: np.ndarray) -> str:
    return hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows id, part, ids, row: piece ids of the texts of at most GIANT characters (part 0) and of every chunk of longer ones.

    Null and empty texts give one row with no ids.  A text's pieces are those of its parts in order.  Ids may be null or
    repeated: `row` tells the giant texts of one id apart (null for others, which are one row each).  Other columns are dropped.
    """
    tn.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    id_type = source.schema[id_col].dataType.simpleString()
    small = F.coalesce(F.length("_text"), F.lit(0)) <= GIANT

    def small_task(batches):
        enc = Encoder(vocabulary)
        for part in tn.slices(batches, "_text", SLICE):
            ids, cuts = enc.encode_rows(part.column(1))
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.zeros(part.num_rows, np.int64)), lists, pa.nulls(part.num_rows, pa.int64())], names=[id_col, "part", "ids", "row"])

    schema = f"`{id_col}` {id_type}, part long, ids array<int>, row long"
    giant = _encode_giant(source.where(~small), vocabulary, id_col, id_type)
    return source.where(small).mapInArrow(small_task, schema).unionByName(giant.select(id_col, "part", "ids", "row"))


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _lists(flat: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.astype(np.int32)))


def _encode_giant(source: DataFrame, vocabulary: Vocabulary, id_col: str, id_type: str) -> DataFrame:
    """Rows id, row, part, ids, same: the parts of every text; same: they spell the text's own bytes."""
    w = vocabulary.width

    def cut_task(batches):
        from pyspark import TaskContext

        # Numbers of rows: the chunks are written before anything is joined by them.
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                starts = list(range(0, len(text), CHUNK))
                for a in range(0, len(starts), FAN):
                    own = starts[a : a + FAN]
                    halo = [min(lo, w) for lo in own]
                    n = len(own)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([i] * n)), pa.array([row] * n, pa.int64()), pa.array(range(a, a + n), pa.int64()), pa.array([text[lo - h : lo + CHUNK] for lo, h in zip(own, halo, strict=True)]), pa.array(halo, pa.int64())],
                        names=[id_col, "row", "part", "t", "halo"],
                    )
                row += 1

    def runs(batches, size=64):
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                yield batch.slice(a, size)

    def matrix_task(batches):
        enc = Encoder(vocabulary)
        for batch in runs(batches):
            n = batch.num_rows
            heads, middles, tails, closed = [], [], [], []
            for t, halo in zip(_column(batch, "t").to_pylist(), _column(batch, "halo").to_pylist(), strict=True):
                # Boundaries: a space after another character, both known here.
                first = _boundary(t, halo, len(t))
                last = _boundary_back(t, max(halo, 1), len(t)) if first >= 0 else -1
                closed.append(first >= 0)
                heads.append((t[:first] if first >= 0 else t, halo))
                middles.append(t[first:last] if first >= 0 else "")
                tails.append(t[last:] if first >= 0 else "")
            whole = np.array(closed)
            flat, cuts = enc.encode_rows(pa.array(middles))
            raw = enc.decode(flat.astype(np.int64), cuts)[0]
            same = raw.tobytes() == "".join(middles).encode()
            m = enc.matrices(heads)
            score, first, _ = enc.chunks([(t, 0) for t in tails])
            end = enc.forward(score, first, enc.origin(n))[0]
            middle = tn.reduce_rows(vocabulary.scores[flat], cuts)
            joined = np.maximum(end[:, :, None] + middle[:, None, None] + m[:, -1][:, None, :], LOW)
            m = np.where(whole[:, None, None], joined, m)
            yield pa.RecordBatch.from_arrays(
                [_column(batch, id_col), _column(batch, "row"), _column(batch, "part"), pa.array([t for t, _ in heads]), _column(batch, "halo"), pa.array(tails), pa.array(whole), pa.array([same] * n), _lists(flat, cuts), tn.binary([x.tobytes() for x in m])],
                names=[id_col, "row", "part", "head", "halo", "tail", "closed", "same", "middle", "m"],
            )

    key = f"`{id_col}` {id_type}, row long, part long"
    cut = source.mapInArrow(cut_task, f"{key}, t string, halo long").repartition("row", "part")
    chunks = written(cut.mapInArrow(matrix_task, f"{key}, head string, halo long, tail string, closed boolean, same boolean, middle array<int>, m binary"), "chunks")
    chunks = chunks.withColumn("run", F.floor(F.col("part") / FAN))

    def products(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        m = np.stack([np.frombuffer(x, np.int64).reshape(w, w) for x in table.column("m").to_pylist()])
        return table.select(["row", "run"]).slice(0, 1).append_column("m", tn.binary([run_product(m).tobytes()]))

    def before_runs(table: pa.Table) -> pa.Table:
        # A text has at most 2**31 characters, so at most 4,096 runs of 2 KB.
        table = table.sort_by("run")
        value, out = enc_origin(w), []
        for m in table.column("m").to_pylist():
            out.append(value.tobytes())
            value = product(np.frombuffer(m, np.int64).reshape(w, w), value)
        return table.select(["row", "run"]).append_column("entry", tn.binary(out))

    held: list[Encoder] = []  # one for all runs of a task

    def entries(chunk: pa.Table, before: pa.Table) -> pa.Table:
        chunk = chunk.sort_by("part")
        value, entry = np.frombuffer(before.column("entry")[0].as_py(), np.int64).reshape(w, 1), []
        for m in chunk.column("m").to_pylist():
            entry.append(value.tobytes())
            value = product(np.frombuffer(m, np.int64).reshape(w, w), value)
        # For each number of characters (0 .. w - 1) that the next chunk's first piece takes from this
        # chunk, how many characters this chunk's first piece takes from the chunk before.
        enc = held[0] if held else held.append(Encoder(vocabulary)) or held[0]
        closed = chunk.column("closed").to_numpy()
        score, first, _ = enc.chunks(list(zip(chunk.column("head").to_pylist(), chunk.column("halo").to_pylist(), strict=True)))
        back = enc.forward(score, first, np.stack([np.frombuffer(e, np.int64) for e in entry]))[1]
        length = np.diff(first)
        maps = np.zeros((chunk.num_rows, w), np.int64)
        for k in range(w):
            # All paths of a closed chunk pass the end of its head.
            ahead = np.where(closed, 0, k)
            at = first[:-1] + length - ahead - 1
            maps[:, k] = ahead - length
            live = np.flatnonzero(at >= first[:-1])
            at = at[live]
            while len(live):
                at = at - back[at] - 1
                over = at < first[live]
                maps[live[over], k] = first[live[over]] - 1 - at[over]
                live, at = live[~over], at[~over]
        return chunk.select(["row", "run", "part"]).append_column("entry", tn.binary(entry)).append_column("maps", tn.binary([x.tobytes() for x in maps]))

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "descending")])
        out = np.arange(w)
        for m in table.column("maps").to_pylist():
            out = np.frombuffer(m, np.int64)[out]
        return table.select(["row", "run"]).slice(0, 1).append_column("maps", tn.binary([out.tobytes()]))

    def after_runs(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "descending")])
        state, out = 0, []
        for m in table.column("maps").to_pylist():
            out.append(state)
            state = int(np.frombuffer(m, np.int64)[state])
        return table.select(["row", "run"]).append_column("state", pa.array(out, pa.int64()))

    def exits(chunk: pa.Table, after: pa.Table) -> pa.Table:
        chunk = chunk.sort_by([("part", "descending")])
        state, out, came = after.column("state")[0].as_py(), [], []
        for m in chunk.column("maps").to_pylist():
            out.append(state)
            state = int(np.frombuffer(m, np.int64)[state])
            came.append(state)
        return chunk.select(["row", "part", "entry"]).append_column("leave", pa.array(out, pa.int64())).append_column("take", pa.array(came, pa.int64()))

    by = ["row", "run"]
    run_matrices = chunks.select("row", "run", "part", "m").groupBy(by).applyInArrow(products, "row long, run long, m binary")
    before = run_matrices.groupBy("row").applyInArrow(before_runs, "row long, run long, entry binary")
    narrow = chunks.select("row", "run", "part", "head", "halo", "closed", "m")
    linked = written(narrow.groupBy(by).cogroup(before.groupBy(by)).applyInArrow(entries, "row long, run long, part long, entry binary, maps binary"), "linked")
    after = linked.groupBy(by).applyInArrow(composed, "row long, run long, maps binary").groupBy("row").applyInArrow(after_runs, "row long, run long, state long")
    known = linked.groupBy(by).cogroup(after.groupBy(by)).applyInArrow(exits, "row long, part long, entry binary, leave long, take long")

    def spell_task(batches):
        enc = Encoder(vocabulary)
        for batch in runs(batches):
            n = batch.num_rows
            closed, leave, take = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("closed", "leave", "take"))
            middle = _column(batch, "middle")
            mids, mid_cut = middle.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(middle.value_lengths().to_numpy(zero_copy_only=False))))
            heads = list(zip(_column(batch, "head").to_pylist(), _column(batch, "halo").to_pylist(), strict=True))
            tails = _column(batch, "tail").to_pylist()

            def spelled(texts, entry, drop):
                score, first, (prefix, own, begin, size, where) = enc.chunks(texts)
                back = enc.forward(score, first, entry)[1]
                mark = enc.trace(back, first, np.diff(first) - drop)
                flat, count = enc.spell(prefix, back, mark, own, begin, size, where)
                return flat, np.concatenate(([0], np.cumsum(count)))[first]

            entry = np.stack([np.frombuffer(e, np.int64) for e in _column(batch, "entry").to_pylist()])
            a, a_cut = spelled(heads, entry, np.where(closed, 0, leave))
            b, b_cut = spelled([(t, 0) for t in tails], enc.origin(n), np.where(closed, leave, 0))
            ids, same = [], []
            for i in range(n):
                text, halo = heads[i]
                parts = [a[a_cut[i] : a_cut[i + 1]], mids[mid_cut[i] : mid_cut[i + 1]], b[b_cut[i] : b_cut[i + 1]]]
                ids.append(np.concatenate(parts))
                want = [text[halo - take[i] : len(text) - (0 if closed[i] else leave[i])], tails[i][: len(tails[i]) - leave[i]] if closed[i] else ""]
                got = [enc.decode(x.astype(np.int64), np.array([0, len(x)]))[0].tobytes() for x in (parts[0], parts[2])]
                same.append(got == [x.encode() for x in want])
            cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
            ok = _column(batch, "same").to_numpy(zero_copy_only=False).astype(bool) & np.array(same)
            yield pa.RecordBatch.from_arrays([_column(batch, id_col), _column(batch, "row"), _column(batch, "part"), _lists(np.concatenate(ids), cuts), pa.array(ok)], names=[id_col, "row", "part", "ids", "same"])

    every = chunks.drop("m", "run").join(known, ["row", "part"])
    return every.mapInArrow(spell_task, f"{key}, ids array<int>, same boolean")


def enc_origin(width: int) -> np.ndarray:
    value = np.full((width, 1), LOW, np.int64)
    value[-1] = 0
    return value


def _boundary(t: str, lo: int, hi: int) -> int:
    """The first place at or after lo, before hi, that holds a space after another character; -1 if there is none."""
    p = t.find(" ", lo, hi)
    while p >= 0 and (p == 0 or t[p - 1] == " "):
        p = t.find(" ", p + 1, hi)
    return p


def _boundary_back(t: str, lo: int, hi: int) -> int:
    """The last such place."""
    p = t.rfind(" ", lo, hi)
    while p >= lo and t[p - 1] == " ":
        p = t.rfind(" ", lo, p)
    return p


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id") -> DataFrame:
    """Rows id, part, text, row of rows id, part, ids, row; bytes that are no UTF-8 become the replacement character."""
    tn.ship_code(encoded.sparkSession)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def decode_task(batches):
        enc = Encoder(vocabulary)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lists = part.column(2)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                cuts = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
                raw, first = enc.decode(ids, cuts)
                rows = [raw[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(rows, pa.string()), part.column(3)], names=[id_col, "part", "text", "row"])

    return encoded.select(id_col, "part", "ids", "row").mapInArrow(decode_task, f"`{id_col}` {id_type}, part long, text string, row long")


def report(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, n_pieces, ids_sha256, decoded_sha256, round_trip.

    ids_sha256 is over the parts' digests in order; decoded_sha256 is of the decoded text; round_trip: every part's
    bytes were compared with the text's own.  Null texts count as empty; ids may be null or repeated.
    """
    source = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    id_type = source.schema[id_col].dataType.simpleString()
    small = F.length("_text") <= GIANT

    def both_task(batches):
        enc = Encoder(vocabulary)
        for part in tn.slices(batches, "_text", SLICE):
            ids, cuts = enc.encode_rows(part.column(1))
            raw, first = enc.decode(ids, cuts)
            buf, off = tn.text_bytes(part.column(1))
            cut, at, o = cuts.tolist(), first.tolist(), off.tolist()
            digest = [hashlib.sha256(_digest(ids[a:b]).encode()).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            decoded = [raw[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            same = [d == buf[a:b].tobytes() for d, a, b in zip(decoded, o[:-1], o[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(cuts)), pa.array(digest), pa.array([hashlib.sha256(d).hexdigest() for d in decoded]), pa.array(same)],
                names=[id_col, "n_pieces", "ids_sha256", "decoded_sha256", "round_trip"],
            )

    tn.ship_code(docs.sparkSession)
    few = source.where(small).mapInArrow(both_task, f"`{id_col}` {id_type}, n_pieces long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
    encoded = _encode_giant(source.where(~small), vocabulary, id_col, id_type)

    def digest_task(batches):
        enc = Encoder(vocabulary)
        for batch in batches:
            ids = [x.values.to_numpy(zero_copy_only=False) for x in _column(batch, "ids")]
            raw = [enc.decode(x.astype(np.int64), np.array([0, len(x)]))[0].tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [*(_column(batch, c) for c in (id_col, "row", "part", "same")), pa.array([len(x) for x in ids]), pa.array([_digest(x) for x in ids]), pa.array([r.decode("utf-8", "replace") for r in raw])],
                names=[id_col, "row", "part", "same", "n", "d", "t"],
            )

    parts = encoded.mapInArrow(digest_task, f"`{id_col}` {id_type}, row long, part long, same boolean, n long, d string, t string")
    # The parts of one text together are as long as the text, which was one row.
    in_order = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", name))), lambda s: s[name]), "")
    long = parts.groupBy("row").agg(
        F.first(id_col).alias(id_col), F.sum("n").alias("n_pieces"), F.sha2(in_order("d").cast("binary"), 256).alias("ids_sha256"), F.sha2(in_order("t").cast("binary"), 256).alias("decoded_sha256"),
        F.bool_and("same").alias("round_trip"),
    ).drop("row")
    return few.unionByName(long)


def query(spark, sf_dir: str, path: str = "/opt/tokenizers/piece_bpe_32k.model") -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return report(docs, load(path))
