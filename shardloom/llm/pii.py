"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

Four kinds have a fixed base pattern (see `base_spans`).  The field adds spans of the same kinds that the
patterns miss: phone numbers in brackets or without a plus sign, addresses at a host without a dot, and
so on.  Its features are the shape of a word and of its neighbours and a few cue words; it is trained by
gradient ascent on the likelihood of the small table in `pii_table`, and decoded by Viterbi over many
word sequences at once.

Words of plain shape far from any digit, sign or cue are outside every span.  Training checks that on such
a stretch the best path between any two labels passes through "outside", so a text may be cut there: a
sequence is a group of noticeable words with PAD plain ones around it, and this loses nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.llm import textnp as tn
from shardloom.llm.pii_table import CUES, EXAMPLES

KINDS = ("email", "ip", "card", "phone")
PAD = 4

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, code points, by start and kind.

    Each kind is found on its own, leftmost and without overlap; a match that fails its check is
    dropped.  The searches are written so that each takes time in proportion to the text.
    """
    out = []
    done = 0
    at = text.find("@")
    while at >= 0:
        lo = at
        while lo > done and _LOCAL.match(text, lo - 1):
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            out.append((lo, m.end(), 0))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    for m in _CHAIN.finditer(text):
        if m.group().count(".") >= 3:
            parts, lo = m.group().split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                hi = lo + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                    out.append((lo, hi, 1))
                lo = hi + 1
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group()) if m.end() - m.start() < 60 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


# Classes of a byte in a word's shape; runs of one class count once.
_UPPER, _LOWER, _DIGIT, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = _UPPER, _LOWER, _DIGIT
for _i, _c in enumerate("@.+-()_%:/#=*,;!?\"'[]"):
    _CLASS[ord(_c)] = 5 + _i
_CLASS[128:] = _LOWER
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?\"'[]<>"]] = True
#: Byte classes that make a word noticeable.
_NOTE = np.zeros(256, bool)
_NOTE[[ord(c) for c in "0123456789@+%_=#"]] = True


class Shapes:
    """Words of a text buffer with two hashes each: of the shape (digit runs keep their length up to 7)
    and of the lower-case letters without punctuation at the ends."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.words = w = tn.Words(buf, off)
        noted = np.concatenate(([0], np.cumsum(_NOTE[buf])))
        self.noted = noted[w.end] > noted[w.start]
        a, b = w.start.copy(), w.end.copy()
        for _ in range(3):
            a += (a < b - 1) & _EDGE[buf[np.minimum(a, len(buf) - 1)]]
            b -= (a < b - 1) & _EDGE[buf[np.maximum(b - 1, 0)]]
        self.core_start, self.core_end = a, b
        self.cue = tn.keyed_hash(tn.lower(buf), a, b)

    def shape(self, buf: np.ndarray, pick: np.ndarray, lengths: bool = True) -> np.ndarray:
        """Shape hashes of the picked words' cores; without `lengths` every run of digits is one sign."""
        size = self.core_end[pick] - self.core_start[pick]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(self.core_start[pick], size)
        cls = _CLASS[buf[at]]
        new = np.ones(len(cls), bool)
        new[1:] = cls[1:] != cls[:-1]
        new[first[:-1][size > 0]] = True
        run = np.flatnonzero(new)
        length = np.minimum(np.diff(np.append(run, len(cls))), 7)
        code = np.where((cls[run] == _DIGIT) & lengths, 100 + length, cls[run]).astype(np.uint8)
        rfirst = np.searchsorted(run, first)
        if not len(run):
            return np.zeros(len(pick), np.uint64)
        return tn.keyed_hash(code, rfirst[:-1], rfirst[1:])


PLAIN = 0


@dataclass
class ShapeField:
    """shapes, coarse, cues: sorted hashes with known numbers (0: plain or unknown word).

    emit: feature template -> (values, labels); move: (labels, labels).
    Templates: shape of the word, of the word before and after, cue of the word before and of the word itself, coarse shape.
    """

    labels: list[str]
    shapes: np.ndarray
    coarse: np.ndarray
    cues: np.ndarray
    emit: list[np.ndarray]
    move: np.ndarray

    def scores(self, f: np.ndarray) -> np.ndarray:
        return sum(e[f[..., i]] for i, e in enumerate(self.emit))


def number(keys: np.ndarray, h: np.ndarray, unknown: int = 0) -> np.ndarray:
    """1 + position of each hash in sorted keys, or `unknown`."""
    p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[p] == h, p + 1, unknown)


def features(shape: np.ndarray, coarse: np.ndarray, cue: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(words, 6) feature numbers; `first` cuts the words into sequences."""
    f = np.zeros((len(shape), 6), np.int64)
    f[:, 0], f[:, 4], f[:, 5] = shape, cue, coarse
    f[1:, 1], f[1:, 3] = shape[:-1], cue[:-1]
    f[:-1, 2] = shape[1:]
    a = first[:-1][np.diff(first) > 0]
    b = first[1:][np.diff(first) > 0] - 1
    f[a, 1] = f[a, 3] = 0
    f[b, 2] = 0
    return f


def viterbi(model: ShapeField, f: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of every sequence, all at once; each starts and ends beside label 0 (outside)."""
    size = np.diff(first)
    out = np.zeros(len(f), np.int64)
    k = len(model.labels)
    order = np.argsort(-size, kind="stable")
    order = order[size[order] > 0]
    if not len(order):
        return out
    longest = int(size[order[0]])
    live = np.searchsorted(-size[order], -np.arange(1, longest + 1), side="right")
    best = np.zeros((len(order), k))
    back = []
    for t in range(longest):
        rows = order[: live[t]]
        e = model.scores(f[first[rows] + t])
        if t == 0:
            best = model.move[0] + e
            back.append(np.zeros((len(rows), k), np.int8))
            continue
        step = best[: len(rows), :, None] + model.move
        back.append(step.argmax(axis=1).astype(np.int8))
        best[: len(rows)] = step.max(axis=1) + e
    label = np.zeros(len(order), np.int64)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        ending = size[order[:n]] == t + 1
        label[:n] = np.where(ending, (best[:n] + model.move[:, 0]).argmax(axis=1), label[:n])
        out[first[order[:n]] + t] = label[:n]
        label[:n] = back[t][np.arange(n), label[:n]]
    return out


def _table() -> tuple[list[str], list[list[str]]]:
    """Plain texts of the labelled table and a label for each of their words."""
    texts, labels = [], []
    for line in EXAMPLES:
        words, tags, kind = [], [], None
        for word in line.split():
            if word.startswith("{"):
                kind = word[1:]
                fresh = True
                continue
            if word == "}":
                kind = None
                continue
            words.append(word)
            tags.append("O" if kind is None else ("B-" if fresh else "I-") + kind)
            fresh = False
        texts.append(" ".join(words))
        labels.append(tags)
    return texts, labels


def train(*, epochs: int = 120, rate: float = 0.2, l2: float = 2e-3) -> ShapeField:
    """Fit the field on the labelled table by full-batch AdaGrad on the log-likelihood."""
    texts, tags = _table()
    labels = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
    y = [np.array([labels.index(t) for t in line]) for line in tags]
    buf, off = tn.text_bytes(pa.array(texts))
    s = Shapes(buf, off)
    n = len(s.cue)
    cue_buf, cue_off = tn.text_bytes(pa.array(CUES))
    cues = np.unique(Shapes(cue_buf, cue_off).cue)
    first = s.words.first
    cue = number(cues, s.cue)
    near = _active(s.noted, cue, first)
    raw, rough = s.shape(buf, np.arange(n)), s.shape(buf, np.arange(n), lengths=False)
    # A shape seen once counts as unknown, so that training meets unknown shapes too and learns from their coarse form.
    seen, times = np.unique(raw[s.noted], return_counts=True)
    shapes, coarse = seen[times > 1], np.unique(rough[s.noted])
    f = features(np.where(near, _shape_number(shapes, raw, s.noted), PLAIN), np.where(near, _shape_number(coarse, rough, s.noted), PLAIN), cue, first)
    k = len(labels)
    emit = [np.zeros((m, k)) for m in (len(shapes) + 2, len(shapes) + 2, len(shapes) + 2, len(cues) + 1, len(cues) + 1, len(coarse) + 2)]
    model = ShapeField(labels, shapes, coarse, cues, emit, np.zeros((k, k)))
    g2 = [np.full(e.shape, 1e-2) for e in emit]
    m2 = np.full((k, k), 1e-2)
    for _ in range(epochs):
        grad = [-l2 * e * len(y) for e in emit]
        gm = -l2 * model.move * len(y)
        for i, gold in enumerate(y):
            ff = f[first[i] : first[i + 1]]
            e = model.scores(ff)
            t = len(gold)
            fw, bw = np.zeros((t, k)), np.zeros((t, k))
            fw[0] = model.move[0] + e[0]
            for j in range(1, t):
                fw[j] = np.logaddexp.reduce(fw[j - 1][:, None] + model.move, axis=0) + e[j]
            bw[-1] = model.move[:, 0]
            for j in range(t - 2, -1, -1):
                bw[j] = np.logaddexp.reduce(model.move + (e[j + 1] + bw[j + 1])[None, :], axis=1)
            z = np.logaddexp.reduce(fw[-1] + bw[-1])
            node = -np.exp(fw + bw - z)
            node[np.arange(t), gold] += 1
            for c, g in enumerate(grad):
                np.add.at(g, ff[:, c], node)
            gm[0] -= np.exp(fw[0] + bw[0] - z)
            gm[0, gold[0]] += 1
            gm[:, 0] -= np.exp(fw[-1] + bw[-1] - z)
            gm[gold[-1], 0] += 1
            for j in range(1, t):
                gm -= np.exp(fw[j - 1][:, None] + model.move + (e[j] + bw[j])[None, :] - z)
                gm[gold[j - 1], gold[j]] += 1
        for e, g, s2 in zip(emit, grad, g2, strict=True):
            s2 += g**2
            e += rate * g / np.sqrt(s2)
        m2 += gm**2
        model.move += rate * gm / np.sqrt(m2)
    if not cut_safe(model):
        raise ValueError("the trained field may carry a label across plain words; sequences can't be cut there")
    return model


def cut_safe(model: ShapeField) -> bool:
    """Whether between any two labels, PAD plain words on either side, the best path is outside in the middle."""
    plain = sum(e[PLAIN] for e in model.emit)
    step = model.move + plain[None, :]
    half = step
    for _ in range(PAD - 1):
        half = (half[:, :, None] + step[None, :, :]).max(axis=1)
    whole = half[:, :, None] + half[None, :, :]
    return bool((whole.argmax(axis=1) == 0).all())


def _shape_number(shapes: np.ndarray, raw: np.ndarray, noted: np.ndarray) -> np.ndarray:
    """Known shapes of noticeable words, one number for unknown ones, PLAIN for other words."""
    return np.where(noted, number(shapes, raw, len(shapes) + 1), PLAIN)


def _active(noted: np.ndarray, cue: np.ndarray, first: np.ndarray) -> np.ndarray:
    return noted | (cue > 0)


def added_spans(buf: np.ndarray, off: np.ndarray, model: ShapeField) -> list[tuple[int, int, int, int]]:
    """(row, first byte, last byte + 1, kind) of the spans that the field finds in rows of a text buffer."""
    s = Shapes(buf, off)
    n = len(s.cue)
    if not n:
        return []
    cue = number(model.cues, s.cue)
    hot = np.flatnonzero(_active(s.noted, cue, s.words.first))
    if not len(hot):
        return []
    row = np.searchsorted(s.words.first, hot, side="right") - 1
    # Sequences: noticeable words less than 2 * PAD + 2 words apart in one row, with PAD words around them.
    new = np.ones(len(hot), bool)
    new[1:] = (row[1:] != row[:-1]) | (hot[1:] - hot[:-1] > 2 * PAD + 1)
    lo = np.maximum(hot[new] - PAD, s.words.first[row[new]])
    last = np.append(np.flatnonzero(new)[1:], len(hot)) - 1
    hi = np.minimum(hot[last] + PAD + 1, s.words.first[row[last] + 1])
    size = hi - lo
    first = np.concatenate(([0], np.cumsum(size)))
    word = np.arange(first[-1]) - np.repeat(first[:-1], size) + np.repeat(lo, size)
    raw, rough = s.shape(buf, word), s.shape(buf, word, lengths=False)
    f = features(_shape_number(model.shapes, raw, s.noted[word]), _shape_number(model.coarse, rough, s.noted[word]), cue[word], first)
    label = viterbi(model, f, first)
    start = np.flatnonzero((label > 0) & (label % 2 == 1))
    out = []
    for a in start.tolist():
        b = a + 1
        end = first[np.searchsorted(first, a, side="right")]
        while b < end and label[b] == label[a] + 1:
            b += 1
        r = int(np.searchsorted(s.words.first, word[a], side="right") - 1)
        lo, hi, kind = int(s.core_start[word[a]]), int(s.core_end[word[b - 1]]), int(label[a] - 1) // 2
        if KINDS[kind] == "card":
            # A number that fails the check sum is no card, whatever stands beside it.
            digits = _NOT_DIGIT.sub("", buf[lo:hi].tobytes().decode())
            if not 14 <= len(digits) <= 19 or not luhn(digits):
                continue
        out.append((r, lo, hi, kind))
    return out


def find(docs: DataFrame, model: ShapeField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, spans and base_spans, arrays of (start, end, kind) by start, then kind.

    Offsets count code points, ends are exclusive.  An added span that touches a base span is dropped.
    Null texts count as empty and have no spans.  Repeated rows and null ids have rows of their own.  Other columns of the input are dropped.
    """
    tn.ship_code(docs.sparkSession)
    source = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    span = "array<struct<start:int,end:int,kind:string>>"
    id_type = source.schema[id_col].dataType.simpleString()
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def find_task(batches):
        for part in tn.slices(batches, "_text"):
            texts = part.column(1).to_pylist()
            base = [base_spans(t) if t else [] for t in texts]
            buf, off = tn.text_bytes(part.column(1))
            every = [list(x) for x in base]
            found = added_spans(buf, off, model)
            if found:
                points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
                for row, a, b, kind in found:
                    lo, hi = int(points[a] - points[off[row]]), int(points[b] - points[off[row]])
                    if all(hi <= x or lo >= y for x, y, _ in base[row]):
                        every[row].append((lo, hi, kind))
            as_rows = lambda spans: [{"start": a, "end": b, "kind": KINDS[k]} for a, b, k in sorted(spans, key=lambda s: (s[0], s[2]))]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([as_rows(x) for x in every], arrow), pa.array([as_rows(x) for x in base], arrow)],
                names=[id_col, "spans", "base_spans"],
            )

    return source.mapInArrow(find_task, f"`{id_col}` {id_type}, spans {span}, base_spans {span}")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: ShapeField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows and columns with every span's characters replaced by [KIND]; null texts stay null."""
    tn.ship_code(docs.sparkSession)
    at = docs.columns.index(text_col)

    def redact_task(batches):
        for part in tn.slices(batches, text_col):
            texts = part.column(at).to_pylist()
            buf, off = tn.text_bytes(part.column(at))
            every = [base_spans(t) if t else [] for t in texts]
            points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
            for row, a, b, kind in added_spans(buf, off, model):
                every[row].append((int(points[a] - points[off[row]]), int(points[b] - points[off[row]]), kind))
            out = []
            for t, spans in zip(texts, every, strict=True):
                if t is not None and spans:
                    pieces, done = [], 0
                    for a, b, kind in sorted(spans):
                        if a >= done:
                            pieces += [t[done:a], f"[{KINDS[kind].upper()}]"]
                        done = max(done, b)
                    t = "".join([*pieces, t[done:]])
                out.append(t)
            yield part.set_column(at, part.schema.field(at), pa.array(out, part.schema.field(at).type))

    return docs.mapInArrow(redact_task, docs.schema)


def report(docs: DataFrame, model: ShapeField, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_email, n_ip, n_card, n_phone, base_sha256 and spans, as kind:start:end joined by commas."""
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return find(docs, model, id_col=id_col, text_col=text_col).select(
        id_col, *[count(k) for k in KINDS], F.sha2(joined(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


def query(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), train())
