"""Identifiers: the base against plain patterns, the bootstrapping against a plain rewrite."""

import hashlib
import random
import re
import time
from collections import defaultdict

import pytest

from leakatlas.llm import pii
from leakatlas.llm.pii import KINDS

PLAIN = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = [True, all(int(x) <= 255 for x in m.group().split(".")) if kind == 1 else True, 16 <= len(digits) <= 19 and plain_luhn(digits), 8 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_equals_the_plain_patterns():
    rng = random.Random(4)
    pieces = ["a", "b.c", "@", "@x.y", ".", "..", "-", "+1", "+", " ", "  ", "(", ")", "1", "25", "255", "256", "0255", "1.2.3.4", "4111111111111111", "4111 1111-1111 1111", "é", "%", "\n", "00000000000000000", "_"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_base(text), text


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "1 " * 500_000, "a@" * 500_000, "1." * 500_000, "+1 (" * 250_000, "@" * 1_000_000, "a@b." * 250_000, "1:" * 500_000, "(" * 1_000_000, "+1" + " " * 1_000_000])
def test_hostile_texts_take_linear_time(text):
    began = time.time()
    pii.candidates(text, pii.base_spans(text))
    assert time.time() - began < 20


def test_candidate_forms():
    text = "call 555 010-7788 or bob (at) mail [dot] example, 10[.]0[.]0[.]1 fe80::1:2 x1234567 2024, jo@localhost a@b.com (650) 555-0100."
    got = [(text[s:e], kinds) for kinds, s, e in pii.candidates(text, pii.base_spans(text))]
    assert got == [("555 010-7788", 8), ("bob (at) mail [dot] example", 1), ("10[.]0[.]0[.]1", 2), ("fe80::1:2", 2), ("jo@localhost", 1), ("(650) 555-0100", 8)]


# ---- a plain rewrite of the method ----


def plain_patterns(words, text, s, e):
    """Contexts as readable tuples; ``words`` are (start, end, folded)."""
    before = [w for a, b, w in words if b <= s and not (a <= s < b)]
    after = [w for a, b, w in words if a >= e]
    out = []
    if before:
        out.append(("L", before[-1]))
    if len(before) > 1:
        out.append(("LL", *before[-2:]))
    if after:
        out.append(("R", after[0]))
    if len(after) > 1:
        out.append(("RR", *after[:2]))
    return out


def fold(w):
    return "".join(c.lower() if c.isascii() else c for c in w)


def plain_found(texts):
    totals, mentions = defaultdict(int), []
    for t, text in enumerate(texts):
        words = [(m.start(), m.end(), fold(m.group())) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        ws = [w for *_, w in words]
        for i in range(len(ws)):
            if i >= 1:
                totals["L", ws[i - 1]] += 1
                totals["R", ws[i]] += 1
            if i >= 2:
                totals["LL", ws[i - 2], ws[i - 1]] += 1
                totals["RR", ws[i - 1], ws[i]] += 1
        base = plain_base(text or "")
        cands = [(-1, ks, s, e) for ks, s, e in pii.candidates(text or "", base)]
        for kind, kinds, s, e in [(k, 1 << k, s, e) for k, s, e in base] + cands:
            value = re.sub("[^0-9]", "", text[s:e]) if kinds >= 4 else text[s:e].lower()
            mentions.append((t, kind, kinds, s, e, value, plain_patterns(words, text, s, e)))
    seeds = {(v, k) for _, k, _, _, _, v, _ in mentions if k >= 0}
    known = {}
    for _, k, kinds, _, _, v, _ in mentions:
        if k < 0:
            same = [j for w, j in seeds if w == v and kinds >> j & 1]
            if same:
                known[v] = min(same)
    while True:
        n, values = defaultdict(int), defaultdict(set)
        for _, k, kinds, _, _, v, patterns in mentions:
            k = known.get(v, -1) if k < 0 else k
            if k >= 0 and kinds >> k & 1:
                for p in patterns:
                    n[p, k] += 1
                    values[p, k].add(v)
        trust = {pk: min(c, totals[pk[0]]) / (totals[pk[0]] + 1) for pk, c in n.items() if len(values[pk]) >= pii.SUPPORT}
        trust = {pk: x for pk, x in trust.items() if x >= pii.TRUST}
        met = defaultdict(dict)
        for _, k, kinds, _, _, v, patterns in mentions:
            if k < 0 and v not in known:
                for p in patterns:
                    for j in range(4):
                        if kinds >> j & 1 and (p, j) in trust:
                            met[v, j][p] = trust[p, j]
        best = {}
        for (v, j), ts in met.items():
            miss = 1.0
            for x in ts.values():
                miss *= 1 - x
            if 1 - miss >= pii.ACCEPT and (v not in best or (-(1 - miss), j) < best[v]):
                best[v] = (-(1 - miss), j)
        if not best:
            break
        known.update({v: j for v, (_, j) in best.items()})
    spans = [[] for _ in texts]
    for t, k, kinds, s, e, v, _ in mentions:
        k = known.get(v, -1) if k < 0 else k
        if k >= 0 and kinds >> k & 1:
            spans[t].append((k, s, e))
    return [sorted(s) for s in spans], known


def texts():
    rng = random.Random(9)
    fill = [f"w{i}" if i % 3 else f"word{chr(97 + i % 26)}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(fill) for _ in range(n))
    out = []
    for i in range(40):  # a cue for phones, mostly in the form of the base
        out.append(f"{some(9)} please ring me on +1 (650) 555-{1000 + i} before noon {some(5)}")
    for i in range(12):  # the cue with local numbers
        out.append(f"{some(6)} please ring me on 555-{7000 + i} before noon {some(4)}")
    for i in range(8):  # a second cue that only the local numbers know
        out.append(f"{some(6)} my desk line 555-{7000 + i} ext {some(4)}")
    for i in range(5):  # found in the second round only
        out.append(f"{some(6)} my desk line 444-{9000 + i} ext {some(4)}")
    for i in range(30):  # numbers of the same form that are no identifiers
        out.append(f"{some(6)} part number 555-{2000 + i} costs {some(4)} the {300 + i}-{5000 + i} of")
    for i in range(14):
        out.append(f"{some(4)} write to user{i}@mail.example.com today {some(3)}" if i < 9 else f"{some(4)} write to user{i} (at) mail [dot] org today {some(3)}")
    out += [f"{some(4)} same number 1 650 555 1003 again", None, "", "  \n", "+1 (650) 555-1000", "Ünï +1 (650) 555-2222 日本 jo@x.org", out[3], out[3], "x" * 5000]
    out += [f"{some(3)} please ring me on +1 (650) 555-1001 before noon " + "é" * 50] * 60  # a hot copy
    return out


def test_bootstrapping_equals_the_plain_rewrite(spark):
    rows = list(enumerate(texts())) + [(None, "a@b.org"), (0, "please ring me on 555-7000 before noon")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, mentions string, kind int").repartition(5)
    want, known = plain_found([t for _, t in rows])
    assert any(v.startswith("444") for v in known) and not any(v.startswith("5552") for v in known) and any("(at)" in v for v in known)
    got = pii.find_identifiers(df).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    have = sorted(((r.doc_id, [(s.kind, s.first, s.past) for s in r.spans]) for r in got), key=key)
    assert have == sorted(((i, s) for (i, _), s in zip(rows, want, strict=True)), key=key)
    for r in got:
        assert (r["mentions"], r["kind"]) == ("clash", 1)
        assert {tuple(s) for s in r.base} <= {tuple(s) for s in r.spans}


def test_common_words_teach_nothing(spark, docs, plain):
    """Only what the base finds in texts without cues."""
    got = pii.find_identifiers(docs.select("doc_id", "text")).collect()
    assert sorted(len(r.spans) for r in got) == sorted(len(plain_base(t or "")) for _, t in plain)


def test_no_rows(spark, no_docs):
    assert pii.find_identifiers(no_docs).count() == 0


def test_query(spark, sf_dir):
    from leakatlas.llm.all_queries import QUERIES

    texts_of = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op11_pii"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts_of)
    order = sorted(texts_of)
    every, _ = plain_found([texts_of[i] for i in order])
    for i, spans in zip(order, every, strict=True):
        r = next(x for x in got if x.doc_id == i)
        base = plain_base(texts_of[i])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, *_ in base) for j in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        assert r.spans == ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
