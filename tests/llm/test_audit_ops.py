"""License scan, importance resampling and filter audit against brute force on small odd tables."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from precinctlab.llm import filter_audit, importance, license_scan

SCHEMA = "doc_id long, text string, lang string, weight long, part string, base string, n long, mask long, blocks long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
GPL, APACHE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "Licensed under the Apache License, Version 2.0."


def wrapped(text, per=5, mark="# "):
    w = text.split()
    return "\n".join(mark + " ".join(w[i : i + per]) for i in range(0, len(w), per))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdeéß") for _ in range(r.randint(2, 6))) for _ in range(80)] + ["the", "License", "of", "public", "MIT", "cc", "by", "gnu", "Ärger", "N°5", "x\x00y", "GNU", "wor\u212a", "L\u0130CENSE", "l\u0130cense", "MIT Li\u00e7ense"]
    filler = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    texts = [None, "", "  \n", "MIT", "MIT License", "mit-license MIT LICENSE", "CC BY CC BY-SA", "cc by " * 3, GPL, GPL.replace("free ", "").replace("can ", ""), GPL.replace("free ", "").replace("can ", "").replace("terms ", ""), APACHE, "A" * 5000, "be " * 400, "#"]
    texts += [filler(31) + "\n" + wrapped(GPL) + "\n" + filler(90), filler(57) + " " + APACHE + " " + filler(3000), "Licensed under CC BY NC 4.0; permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. \u212a wor\u212a", "this is free and unencumbered software released into the public domain".upper().replace("K", "\u212a"), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"]
    texts += [filler(r.randint(5, 260)) for _ in range(40)]
    texts += [texts[30]] * 5 + [texts[31], texts[31] + " ", texts[8], ""]
    rows = [(i, t, [None, "en", "de", "fr"][i % 4], 1, "p", "b", 2, 3, 4) for i, t in enumerate(texts)]
    rows += [rows[-1], rows[20], (None, texts[30], "en", 1, "p", "b", 2, 3, 4), (None, "no id", "en", 1, "p", "b", 2, 3, 4), (3, texts[40], "en", 1, "p", "b", 2, 3, 4)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 3 % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, 1, 0), (None, 1, 1), (900, 1, 1), (6, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def licenses(t):
    w = words(t)
    base = [(i, name) for p, name in license_scan.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    hits = []
    for b in range(0, math.ceil(len(w) / 32)):
        block = set(w[32 * b : 32 * b + 64])
        for name, text in license_scan.TEMPLATES:
            of = set(text.split())
            if 10 * len(of & block) >= 9 * len(of):
                hits.append((b, name, len(of & block) / len(of)))
    join = lambda names: ",".join(sorted(set(names)))
    starts = [i for i, _ in base]
    return (len(w), len(base), min(starts, default=None), max(starts, default=None), join(n for _, n in base), join([n for _, n in base] + [n for _, n, _ in hits]),
            1.0 if base else max((s for *_, s in hits), default=0.0), len({b for b, *_ in hits}))


def test_licenses(docs):
    got = Counter(tuple(r) for r in license_scan.license_report(docs).collect())
    assert got == Counter((r.doc_id, *licenses(r.text)) for r in docs.collect())
    found = {r.labels for r in license_scan.license_report(docs).collect()}
    assert {"gpl", "apache", "bsd", "mit", "cc-by"} <= found


def test_license_threshold(docs):
    """A lower threshold finds what brute force finds, too."""
    got = Counter((r.doc_id, m.block, m.template) for r in license_scan.scan(docs, threshold=0.6).collect() for m in r.matches)
    want = Counter()
    for r in docs.collect():
        w = words(r.text)
        for b in range(math.ceil(len(w) / 32)):
            for i, (_, text) in enumerate(license_scan.TEMPLATES):
                of = set(text.split())
                want[r.doc_id, b, i] += 10 * len(of & set(w[32 * b : 32 * b + 64])) >= 6 * len(of)
    assert got == +want
    with pytest.raises(ValueError):
        license_scan.scan(docs, listed=[("x", "w " * 40)])


def features(t, longest):
    w = words(t)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling(spark, docs, longest):
    target = spark.createDataFrame([(1, "The license of the public éé"), (2, None), (3, GPL)], "item_id long, text string")
    rows, aims = docs.collect(), target.collect()
    s, t = (Counter(f % 500 for r in x for f in features(r.text, longest)) for x in (rows, aims))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 500) / ((s[b] + 1) * (t.total() + 500))))

    def want(r):
        f = features(r.text, longest)
        weight = sum(gain(x % 500) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:8], 16)
        return r.doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    got = importance.resample(docs, target, longest=longest, buckets=500, percent=30).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(map(want, rows))
    may = sorted((want(r) for r in rows if len(words(r.text)) >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    assert sorted((r.rank, tuple(r)[:4]) for r in got if r.rank) == [(i + 1, x) for i, x in enumerate(may[: len(may) * 30 // 100])]


def test_text_pieces():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * importance.PIECE * 2, None, "", "b", "c" * importance.PIECE])], names=["text"])
    assert [len(x) for x in importance.pieces(batch, 0)] == [1, 3, 1]
    assert list(importance.pieces(batch.slice(0, 0), 0)) == []
    bucket, owner, n = importance.feature_buckets(pa.array(["b A b", None, "", "A"]), 2, 1 << 40)
    assert n.tolist() == [3, 0, 0, 1] and sorted(zip(owner.tolist(), bucket.tolist())) == sorted([(0, zlib.crc32(x)) for x in (b"b", b"a", b"b", b"b a", b"a b")] + [(3, zlib.crc32(b"a"))])


def audit_by_hand(rows, labels):
    good, toxic = ({r.doc_id for r in labels if r[c] == 1 and r.doc_id is not None} for c in (1, 2))
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    out, masks = Counter(), []
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
                 "E": t in least and (r.doc_id is None or least[t] < r.doc_id)}
        masks.append((r.lang or "", {f for f in fails if fails[f]}, r.doc_id in good, r.doc_id in toxic))
    for part, f, g, x in masks:
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = False
            for k, c in enumerate(order):
                hit = c in f
                key = part, order, k + 1
                out[*key, "removed"] += hit and not gone
                out[*key, "redundant"] += hit and gone
                out[*key, "unique_fails"] += f == {c}
                out[*key, "good_lost"] += hit and not gone and g
                out[*key, "toxic_lost"] += hit and not gone and x
                out[part, c, "shapley"] += hit and not gone
                gone |= hit
                out[*key, "kept"] += not gone
    return out


def test_audit(docs, labels):
    got, want = filter_audit.audit(docs, labels).collect(), audit_by_hand(docs.collect(), labels.collect())
    assert len(got) == len({(r.part, r.filter_order, r.step) for r in got}) == 600 * 4
    for r in got:
        for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[c] == want[r.part, r.filter_order, r.step, c], (r, c)
        assert r.shapley == want[r.part, r.filter_order[r.step - 1], "shapley"]


def test_sketch_clears_only_unique_texts(docs):
    found = filter_audit.flagged(docs)
    n = Counter(r.text or "" for r in docs.collect())
    sent = [bytes(r.text).decode() for r in found.collect() if r.text is not None]
    assert Counter(sent) >= Counter({t: k for t, k in n.items() if k > 1})
    assert len(sent) < docs.count() * 0.6
    few = filter_audit.sketch(docs, filter_audit.MIN_CELLS)  # what a crowded sketch can't clear goes the exact way
    assert set(few) == {0} and np.unpackbits(np.frombuffer(few[0], np.uint8)).sum() >= 3 * sum(k > 1 for k in n.values()) * 0.9


def test_empty(docs, labels):
    none = docs.where("false")
    assert license_scan.license_report(none).collect() == [] and filter_audit.audit(none, labels).collect() == []
    assert importance.resample(none, none).collect() == []
    assert {r.weight for r in importance.resample(docs, none).collect()} and filter_audit.audit(docs, labels.where("false")).where("good_lost > 0").count() == 0
