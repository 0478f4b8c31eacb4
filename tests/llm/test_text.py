import random
import re

import pyarrow as pa
import pytest

from shardloom.llm import pieces as P
from shardloom.llm import pii
from shardloom.llm import textnp as tn


def test_base_spans_match_the_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("a@.1-+ 2()5é") for _ in range(r.randint(0, 40)))
        digits = lambda m: re.sub("[^0-9]", "", m.group())
        want = [(m.start(), m.end(), 0) for m in email.finditer(t)] + [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        want += [(m.start(), m.end(), 2) for m in card.finditer(t) if 14 <= len(digits(m)) <= 19 and pii.luhn(digits(m))] + [(m.start(), m.end(), 3) for m in phone.finditer(t) if 10 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == sorted(want, key=lambda s: (s[0], s[2])), t


def test_field_adds_spans_and_leaves_prose_alone(spark):
    rows = [(1, "é call me on 555-123-4567, or mail a.b@c.org"), (2, "plain prose with nothing at all in it"), (3, None), (4, ""), (5, "in 2004 at 3.5 we had 40418949746 things 9.9. and 4.0."), (6, "word " * 30000 + "x@y.zz"), (2, "plain prose with nothing at all in it")]
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")
    model = pii.train()
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert [(s.start, s.end, s.kind) for s in got[1].spans] == [(13, 25, "phone"), (35, 44, "email")]
    assert [(s.start, s.end, s.kind) for s in got[1].base_spans] == [(35, 44, "email")]
    assert all(not got[k].spans for k in (2, 3, 4, 5)) and len(got[6].spans) == 1
    red = {r.doc_id: r.text for r in pii.redact(docs, model).collect()}
    assert red[1] == "é call me on [PHONE], or mail [EMAIL]" and red[3] is None and red[2] == rows[1][1]
    assert pii.find(docs.limit(0), model).count() == 0


#: Lines that the field never learns from.
HELD_OUT = [
    "please phone {phone 212-555-0147 } before friday",
    "reach us at {phone (415) 555-0199 } any time",
    "his mobile: {phone 07911 123456 }",
    "fax {phone 0033 1 4555 0101 } or post",
    "text {phone 646.555.0110 } for a reply",
    "call {phone (202) 555-0143, } not the office",
    "tel {phone 030 5550 1234 } from nine",
    "dial {phone +1 (617) 555-0188 } today",
    "ring {phone 312-555-0175. }",
    "mail {email jo.smith@example.net } for the form",
    "email {email admin@mailhost } about access",
    "write to {email k_9@staff.example.org } soon",
    "e-mail: {email sales@shop }",
    "host {ip 10.1.2.3:22 } refused",
    "the ip {ip 192.0.2.17 } is blocked",
    "address {ip 198.51.100.0/24 } is ours",
    "ip {ip 172.20.1.9, } and more",
    "card {card 5555 5555 5555 4444 } was used",
    "visa {card 4012888888881881 } expires",
    "amex {card 3714 496353 98431 } billed",
    "mastercard {card 5105-1051-0510-5100 } on file",
    "in 2007 about 3,400 people came",
    "chapter 12, page 340, line 7",
    "at 08:15 on 12/11/2019 it began",
    "version 10.2.7 of the tool",
    "it costs 19.99 or 25% less",
    "the answer is 42 and not 43",
    "order 99812 of 2020-05-06",
    "room 5 on floor 12",
    "secret=ab12cd34ef56ab78",
    "a 16 digit number 7567553925670233 here",
    "licensed under CC BY-NC 4.0 and 3.0",
    "call me later and mail it",
    "the phone on the card table",
]


def test_added_spans_of_held_out_lines():
    """Recall and precision of the field alone, by kind and overlap."""
    texts, gold = [], []
    for line in HELD_OUT:
        text, own, kind, start = "", [], None, 0
        for word in line.split():
            if word.startswith("{"):
                kind, start = word[1:], len(text) + (1 if text else 0)
            elif word == "}":
                own.append((start, len(text), kind))
            else:
                text += (" " if text else "") + word
        texts.append(text)
        gold.append(own)
    buf, off = tn.text_bytes(pa.array(texts))
    found = [[] for _ in texts]
    for r, a, b, k in pii.added_spans(buf, off, pii.train()):
        found[r].append((a - off[r], b - off[r], pii.KINDS[k]))
    meet = lambda x, y: x[2] == y[2] and x[0] < y[1] and y[0] < x[1]
    caught = sum(any(meet(x, y) for y in f) for g, f in zip(gold, found, strict=True) for x in g)
    right = sum(any(meet(x, y) for x in g) for g, f in zip(gold, found, strict=True) for y in f)
    assert caught >= 0.9 * sum(map(len, gold)) and right >= 0.95 * sum(map(len, found))


def test_report_matches_the_patterns_and_repeats_rows(spark):
    import hashlib

    rows = [(1, "a.b@c.org 10.0.0.1 +44 20 7946 0958"), (1, "a.b@c.org 10.0.0.1 +44 20 7946 0958"), (2, "é 4111 1111 1111 1111, x"), (3, None), (None, "x@y.zz")]
    docs = spark.createDataFrame([(k, t, 1, "s") for k, t in rows], "doc_id long, text string, n_ip int, base_spans string")
    got = sorted(map(tuple, pii.report(docs, pii.train()).collect()), key=repr)
    want = []
    for k, t in rows:
        spans = pii.base_spans(t or "")
        line = ",".join(f"{pii.KINDS[c]}:{a}:{b}" for a, b, c in spans)
        want.append((k, *[sum(c == i for _, _, c in spans) for i in range(4)], hashlib.sha256(line.encode()).hexdigest(), line))
    assert got == sorted(want, key=repr)


def test_viterbi_matches_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    m = pii.ShapeField(["O", "B-x", "I-x"], *[np.zeros(1, np.uint64)] * 3, [rng.normal(size=(4, 3)) for _ in range(6)], rng.normal(size=(3, 3)))
    first = np.array([0, 4, 4, 7])
    f = rng.integers(0, 4, size=(7, 6))
    got = pii.viterbi(m, f, first)
    for a, b in ((0, 4), (4, 7)):
        def total(y, a=a, b=b):
            s = m.move[0, y[0]] + m.move[y[-1], 0] + sum(m.scores(f[a + i])[k] for i, k in enumerate(y))
            return s + sum(m.move[x, z] for x, z in zip(y, y[1:], strict=False))

        assert tuple(got[a:b]) == max(itertools.product(range(3), repeat=b - a), key=total)


def vocabulary():
    texts = ["a", "b", "c", " ", "ab", "bc", "abc", " a", " ab", "  ", "é", "ca", "abca"]
    scores = [-30, -31, -35, -20, -45, -50, -60, -33, -52, -25, -40, -55, -70]
    import numpy as np

    return P.Vocabulary([*texts, *[None] * 256], np.array([*scores, *[0] * 256]), np.arange(13, 269), -90)


def brute(v, text):
    look = {p: i for i, p in enumerate(v.pieces) if p}
    best, back = [0], [None]
    for j in range(1, len(text) + 1):
        top = None
        for l in range(1, min(j, v.width) + 1):
            s = text[j - l : j]
            i = look.get(s, -1)
            if i < 0 and l > 1:
                continue
            c = best[j - l] + (int(v.scores[i]) if i >= 0 else v.byte_score * len(s.encode()))
            if top is None or c >= top[0]:
                top = (c, l, i)
        best.append(top[0])
        back.append(top)
    out, j = [], len(text)
    while j:
        _, l, i = back[j]
        out.append([i] if i >= 0 else [int(v.byte_ids[x]) for x in text[j - l : j].encode()])
        j -= l
    return [x for part in out[::-1] for x in part]


def test_small_and_giant_texts_get_the_best_pieces(spark, monkeypatch):
    v = vocabulary()
    r = random.Random(2)
    make = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    docs = [(i, make("abc é▁\n", r.randint(0, 90))) for i in range(40)] + [(100 + i, make("abcé", r.randint(20, 90))) for i in range(20)] + [(500, None), (501, "")]
    monkeypatch.setattr(P, "GIANT", 40)
    monkeypatch.setattr(P, "CHUNK", 16)
    rows = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, part int")
    got, most = {}, 0
    for x in sorted(P.encode(rows, v).collect(), key=lambda x: (x.doc_id, x.part)):
        got.setdefault(x.doc_id, []).extend(x.ids)
        most = max(most, x.part)
    assert most > 2 and all(got[k] == brute(v, t or "") for k, t in docs)
    text = {}
    for x in sorted(P.decode(P.encode(rows, v), v).collect(), key=lambda x: (x.doc_id, x.part)):
        text[x.doc_id] = text.get(x.doc_id, "") + x.text
    assert all(text[k] == (t or "") for k, t in docs)
    monkeypatch.setattr(P, "FAN", 3)
    report = {x.doc_id: x for x in P.report(rows, v).collect()}
    assert len(report) == len(docs) and all(x.round_trip for x in report.values()) and all(report[k].n_pieces == len(got[k]) for k in got)
    assert P.report(rows.limit(0), v).count() == 0


def test_giant_texts_with_null_or_repeated_ids_keep_all_their_parts(spark, monkeypatch):
    v = vocabulary()
    monkeypatch.setattr(P, "GIANT", 40)
    monkeypatch.setattr(P, "CHUNK", 16)
    r = random.Random(4)
    one, two, spaces = "".join(r.choice("abc") for _ in range(150)), "".join(r.choice("ab c") for _ in range(170)), " " * 100
    docs = [(1, one), (1, one), (None, one), (None, two), (2, spaces), (1, two), (3, "ab")]
    rows = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, row int")
    got = P.report(rows, v).collect()
    n = {t: len(brute(v, t)) for _, t in docs}
    assert sorted(((x.doc_id, x.n_pieces) for x in got), key=repr) == sorted(((k, n[t]) for k, t in docs), key=repr) and all(x.round_trip for x in got)
    assert P.encode(rows, v).count() == 3 * 10 + 2 * 11 + 7 + 1


def test_run_product_is_the_product_in_order():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        m = rng.integers(-50, 0, size=(n, 4, 4))
        want = m[0]
        for x in m[1:]:
            want = P.product(x, want)
        assert (P.run_product(m) == want).all()


def test_colliding_stretches_are_solved_by_their_characters(monkeypatch):
    import numpy as np

    v = vocabulary()
    enc = P.Encoder(v)
    monkeypatch.setattr(P.tn, "keyed_hash", lambda buf, a, b, key=0: np.zeros(len(a), np.uint64))
    ids, cuts = enc.encode_rows(pa.array(["abc", "ca b", "é"]))
    assert [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] == [brute(v, t) for t in ("abc", "ca b", "é")]


def test_max_plus_product_is_associative():
    import numpy as np

    rng = np.random.default_rng(0)
    a, b, c = (rng.integers(-50, 0, size=(4, 4)) for _ in range(3))
    assert (P.product(P.product(a, b), c) == P.product(a, P.product(b, c))).all()


def test_vocabulary_with_inner_spaces_is_refused():
    import numpy as np

    with pytest.raises(ValueError, match="holds a space"):
        P.Vocabulary(["a b"], np.array([-1]), np.zeros(256, int), -9)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_repetitive_structure_hash_apart():
    a = thue_morse(4096)
    words = [a[:n] for n in (200, 1024, 2048, 4096)]
    words += [w.translate(str.maketrans("ab", "ba")) for w in words]
    assert len(set(tn.word_hashes(pa.array([" ".join(words)]))[1].tolist())) == len(words)


def test_word_hashes_do_not_depend_on_place():
    w, h = tn.word_hashes(pa.array(["Ab cd", None, "", "x y AB\tcd\x1f", "cd"]))
    assert w.count.tolist() == [2, 0, 0, 3, 1] and h[0] == h[3] and h[1] == h[5] != h[4]
