"""The training-data operators against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash

from precinctlab.llm import line_join, mixing, passage_chains, piece_viterbi, projection_ann, quality_rules, shared_keys, simhash, suffix_dedup, token_output, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(300)]
    passage = [r.choice(vocabulary) for _ in range(70)]
    texts = [None, "", "  ", "one two", "é ü\n\n x", "be " * 300, "ab" * 300 + " end"]
    for i in range(30):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 200))]
        if i % 5 == 0:
            w[10:10] = passage
        texts.append(" ".join(w[:40]) + ".\n" + " ".join(w[40:]) + ".")
    texts += [texts[10], texts[10], texts[11].replace("a", "b", 1), texts[12] + "!"]
    rows = [(i, t, "en", None if i % 9 == 0 else f"s{i % 4}", 0, 7, 7) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], (None, "no id at all", "en", "s1", 0, 7, 7)], SCHEMA).repartition(3).cache()


def named(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (quality_rules.quality_report, quality_rules.clean_documents, mixing.mix, simhash.near_duplicates, suffix_dedup.repeated_substrings, line_join.line_report, passage_chains.shared_passages):
        assert f(none).collect() == []
    v = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert projection_ann.nearest(v).collect() == []


def test_quality(docs):
    got = Counter((r.doc_id, r.n_words, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_report(docs).collect())

    def want(t):
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(grams)
        covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)

    assert got == Counter((k, *want(t)) for k, t in named(docs))
    assert quality_rules.clean_documents(docs).columns == docs.columns


def test_mixing(docs):
    a = mixing.mix(docs).collect()
    assert len(a) == docs.count() and sum(r.taken for r in a) <= sum(r.size for r in a)
    assert all(r.taken <= 3 * r.size for r in a)
    assert sorted(map(str, a)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    assert math.isclose(sum({r.source: r.target for r in a}.values()), sum(r.size for r in a))
    assert mixing.mixed_documents(docs).count() == sum(r.times for r in a)
    odd = docs.selectExpr("*", "1 as times", "2 as copy", "3 as pass", "4 as finish", "5 as _n")
    assert Counter(map(str, mixing.mixed_documents(odd).select(docs.columns).collect())) == Counter(map(str, mixing.mixed_documents(docs).collect()))


def test_simhash(docs):
    def fp(t):
        w = WORD.findall(t.translate({i: i + 32 for i in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = [(k, fp(t)) for k, t in named(docs)]
    comp = {f: {g for _, g in rows if (f ^ g).bit_count() <= 2} for _, f in rows}
    for _ in rows:
        comp = {f: set().union(*(comp[g] for g in c)) for f, c in comp.items()}
    least = {f: min(k for k, g in rows if g in c and k is not None) for f, c in comp.items() if any(g in c and k is not None for k, g in rows)}
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((k, f"{f:016x}", least.get(f)) for k, f in rows)


@pytest.mark.parametrize("budget", [1, 3])
def test_trie_join(budget):
    r = np.random.default_rng(1)
    k = r.integers(0, 1 << 63, 60, dtype=np.uint64)
    k = np.unique(np.concatenate([k, k ^ np.uint64(1), k ^ np.uint64(6), k ^ np.uint64(7)]))
    i, j, d = simhash.trie_pairs(k, 8, budget)
    want = {(a, b) for a in range(len(k)) for b in range(a + 1, len(k)) if int(k[a]) >> 56 == int(k[b]) >> 56 and (int(k[a]) ^ int(k[b])).bit_count() <= budget}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_suffixes(docs):
    rows = [(k, t.encode()) for k, t in named(docs)]
    n = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = Counter()
    for k, t in rows:
        gone = {j for i in range(len(t) - 199) if n[t[i : i + 200]] > 1 for j in range(i, i + 200)}
        want[(k, len(t), len(gone), sum(j - 1 not in gone for j in gone), hashlib.sha256(bytes(b for j, b in enumerate(t) if j not in gone)).hexdigest())] += 1
    assert Counter(tuple(r)[:5] for r in suffix_dedup.repeated_substrings(docs).collect()) == want


def test_loser_tree():
    r = random.Random(2)
    runs = []
    for _ in range(5):
        s = sorted("".join(r.choice("ab") for _ in range(6)).encode() for _ in range(r.randint(0, 12)))
        lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), 6)
        runs.append((s, [lcp(a, b) if i else 0 for i, (a, b) in enumerate(zip([b"", *s], s))]))
    order, shared = suffix_dedup.merge_runs(runs)
    merged = [runs[a][0][i] for a, i in order]
    assert merged == sorted(merged) and len(merged) == sum(len(s) for s, _ in runs)
    assert shared[1:] == [lcp(a, b) for a, b in zip(merged, merged[1:])]


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def test_edit_join(spark):
    r = random.Random(3)
    lines = []
    for _ in range(12):
        base = "".join(r.choice("abcd ") for _ in range(r.randint(15, 60))).strip()
        lines.append(base)
        for _ in range(4):
            x = list(base)
            for _ in range(r.randint(1, 3)):
                i = r.randrange(len(x))
                x[i : i + 1] = r.choice([[], [r.choice("abcd")], [x[i], r.choice("abcd")]])
            lines.append("".join(x).strip() + "z")
    d = spark.createDataFrame([(i, x, "s") for i, x in enumerate(lines)], "doc_id long, text string, source string")
    different = sorted(set(lines))
    links = Counter()
    for a in different:
        for b in different:
            if a != b and distance(a, b) <= line_join.edits(min(len(a), len(b))):
                links[a] += 1
    got = {r.doc_id: r for r in line_join.line_report(d).collect()}
    assert {i: got[i].n_links for i in got} == {i: links[x] for i, x in enumerate(lines)}
    assert sum(r.n_lines - r.n_removed for r in got.values()) == len({c for r in got.values() for c in r.class_ids})


def grouped(pairs, nodes):
    """Smallest node reachable from each."""
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    return least


def test_passages(spark, docs):
    """Classes and spans against the alignment of all pairs."""
    r = random.Random(14)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(2500)]
    texts = [t for _, t in named(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy("doc_id"))]
    for n, holders in ((60, 14), (45, 9), (90, 6)):  # each holder edits its own words, so seeds lie in all combinations
        passage, phrase = [r.choice(vocabulary) for _ in range(n)], [r.choice(vocabulary) for _ in range(9)]
        for _ in range(holders):
            x = [r.choice(vocabulary) if r.random() < 0.08 else w for w in passage]
            texts.append(" ".join(phrase + [r.choice(vocabulary) for _ in range(r.randint(5, 60))] + x + [r.choice(vocabulary) for _ in range(r.randint(5, 60))]))
    read = [passage_chains.Text(t.encode()) for t in texts]
    spans, equal = {}, []
    for i, a in enumerate(read):
        for j in range(i):
            if texts[i] == texts[j]:
                if len(a.words) >= 40:
                    equal.append((j, i))
                continue
            for x, y in ((i, j), (j, i)):
                spans[x, y] = {p for c in passage_chains.chains(passage_chains.matches(read[x].places(), read[y])) for p in passage_chains.passages(c, read[x], read[y])}
    pairs = [k for k, p in spans.items() if p]
    least = grouped([*pairs, *equal], range(len(texts)))
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[-1], 1)], "doc_id long, text string, t int").repartition(5)
    got = passage_chains.shared_passages(d, exhaustive=True).collect()
    usual = passage_chains.shared_passages(d).collect()
    assert {(x.other_id, x.class_id) for x in usual} == {(x.other_id, x.class_id) for x in got}
    found = {k for x in got for k in (x.doc_id, x.other_id)}
    assert {k for k in found} == {k for p in [*pairs, *equal] for k in p}
    assert all(x.class_id == least[x.doc_id] == least[x.other_id] for x in got)
    first = {t: i for i, t in reversed(list(enumerate(texts)))}
    for x in got:
        if x.copy:
            assert texts[x.doc_id] == texts[x.other_id] and x.doc_id == first[texts[x.doc_id]]
        else:
            assert (x.start, x.end, x.other_start, x.other_end, x.n_equal) in spans[x.doc_id, x.other_id]
            assert x.identity == x.n_equal / max(x.end - x.start, x.other_end - x.other_start) >= 0.8
    # passages shared by every pair of linked texts lead to one class
    assert all(least[a] == least[b] for a, b in pairs) and len({least[k] for k in found}) > 3


def test_word_strings():
    r = random.Random(3)
    texts = [" ".join(r.choice(["a", "b", "Ab", "aB"]) for _ in range(r.randint(0, 30))).encode() for _ in range(40)] + [b"", b"\tx\n y  z w v\r", b"x y z w v"]
    h, owner, place = passage_chains.word_strings(texts)
    want = [(i, j, tuple(w[j : j + 5])) for i, t in enumerate(texts) for w in [t.lower().split()] for j in range(len(w) - 4)]
    assert list(zip(owner.tolist(), place.tolist())) == [x[:2] for x in want]
    assert len(set(h.tolist())) == len({x[2] for x in want}) == len(set(zip(h.tolist(), (x[2] for x in want))))


def test_packed_keys():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    assert (shared_keys.unpack(shared_keys.pack(keys)) == keys).all() and len(shared_keys.unpack(shared_keys.pack(keys[:0]))) == 0
    for bits in (32, 40, 64):
        rows = shared_keys.pack_parts(keys, 3, 7, bits).to_pylist()
        assert [x["part"] for x in rows] == list(range(7))
        assert (np.concatenate([shared_keys.unpack(x["keys"]) for x in rows]) == np.unique(keys >> np.uint64(64 - bits))).all()


def test_tokens_round_trip(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = token_output.encode_and_digest(docs.where("doc_id < 40"), path).orderBy("doc_id").collect()
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(path), 0
    for r, (_, text) in zip(rows, sorted(x for x in named(docs) if x[0] is not None and x[0] < 40)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes(planes):
    ids = np.random.default_rng(0).integers(0, 60_000, 1000).astype("<u4")
    blob = token_output.pack(ids, planes, block=96)
    assert (token_output.unpack(blob) == ids).all() and (token_output.unpack(blob, 2, 1) == ids[192:288]).all()
    assert len(token_output.unpack(token_output.pack(ids[:0], planes))) == 0


def test_piece_ids(spark, docs):
    """Ids of the library, on documents and on texts of odd characters, long words and runs of spaces."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_viterbi.pieces(path)
    r = random.Random(1)
    texts = [t for _, t in named(docs)] + ["".join(r.choice(" ▁  aeithes\n\tnéüß中文🙂♞01.,-_=　") for _ in range(r.randint(0, 60))) for _ in range(2000)]
    texts += ["".join(r.choices(own.symbols, k=r.randint(1, 12))) for _ in range(2000)] + [" " * n + "x" + " " * n for n in range(40)] + ["ab" * 3000, "=-" * 500, "\x00"]
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == library.encode(texts, num_threads=1)
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(7, None, "y")], "doc_id long, text string, ids string")
    back = piece_viterbi.decode_documents(piece_viterbi.encode_documents(d, path), path)
    assert Counter((x.doc_id, x.text) for x in back.collect()) == Counter([(i, t.replace("▁", " ")) for i, t in enumerate(texts)] + [(7, "")])
    assert all(x.exact for x in piece_viterbi.round_trip(docs, path).collect())
    assert piece_viterbi.round_trip(d.where("false"), path).collect() == []


def test_apart():
    """Two neighbours stay apart if and only if merging their union by rank gives them back."""
    own = piece_viterbi.pieces(public_tokenizers.path("piece_bpe_32k.model"))

    def merged(text):
        parts = list(text)
        while len(parts) > 1:
            rank, i = min((own.rank.get(a + b, math.inf), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    r = random.Random(2)
    for a, b in ((r.randrange(len(own.symbols)), r.randrange(len(own.symbols))) for _ in range(4000)):
        assert own.apart(a, b) == (merged(own.symbols[a] + own.symbols[b]) == [own.symbols[a], own.symbols[b]])


@pytest.mark.parametrize("cell_rows", [20_000, 60])
def test_nearest(spark, cell_rows):
    """Against brute force, in one cell and in two rounds over several; equal, huge and tiny vectors and rows that take no part."""
    r = np.random.default_rng(4)
    v = r.standard_normal((700, 16))
    v[5], v[7], v[650:] = v[0], v[50] * 1e200, v[649] + 1e-3 * r.standard_normal((50, 16))
    v[8] = v[50] * 1e-200
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(700)] + [(7, v[7].tolist(), "again"), (None, v[0].tolist(), "x")]
    rows += [(1000, None, ""), (1050, [0.0] * 16, ""), (1100, [float("nan")] * 16, ""), (1150, [1.0], ""), (1151, [2.0], ""), (1200, [None] * 16, ""), (1250, [float("inf")] * 16, "")]
    got = projection_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string"), cell_rows=cell_rows).collect()
    u = v / np.abs(v).max(axis=1)[:, None]
    u /= np.linalg.norm(u, axis=1)[:, None]
    hits = 0
    for q in range(0, 700, 50):
        s = u @ u[q]
        s[q] = -9
        own = {x.rank: x for x in got if x.query_id == q}
        hits += len(set(np.argsort(-s, kind="stable")[:5].tolist()) & {x.vec_id for x in own.values()})
        assert sorted(own) == [1, 2, 3, 4, 5] and all(math.isclose(x.score, s[x.vec_id], abs_tol=1e-12) for x in own.values())
    assert hits >= 0.9 * 70
    assert {x.vec_id for x in got if x.query_id == 50 and x.rank < 3} == {7, 8}
    assert [(x.vec_id, x.rank) for x in got if x.query_id == 1150] == [(1151, 1)] and {x.query_id for x in got} == {*range(0, 700, 50), 1150}


def test_toxicity(spark):
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = [(i, " ".join([*r.choices(words, k=30), *(["scumbag"] if i % 4 == 0 else []), *(["women"] if i % 6 == 0 else [])]), "x") for i in range(400)]
    d = spark.createDataFrame([*rows, (900, None, ""), (901, "", ""), (None, "scumbag", ""), (902, "scumbag " * 60_000, "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(d, labels).collect()}
    assert sum(got[i].predicted == int(i % 4 == 0) for i in range(400) if got[i].held_out) >= 0.95 * sum(got[i].held_out for i in range(400))
    assert got[900].score == got[901].score and got[7].held_out == (zlib.crc32(b"7") % 3 == 1) and len(got) == 404 and not got[None].held_out
    assert toxicity.toxicity(d.where("false"), labels).collect() == []
    assert {x.score for x in toxicity.toxicity(d, labels.where("false")).collect()} == {0.5}


def test_counterfactuals():
    got = toxicity.counterfactuals(b"Nice day. Women and MEN, here! No term")
    assert ({b"women", b"and", b"men", b"here"}, {b"girls", b"and", b"men", b"here"}) in got
    assert ({b"women", b"and", b"men", b"here"}, {b"women", b"and", b"men", b"here"}) in got  # both trade places
    assert ({b"women", b"and", b"men", b"here"}, {b"and", b"men", b"here"}) in got and len(got) == 8
    assert toxicity.counterfactuals(None) == toxicity.counterfactuals(b"none") == []


def test_penalty_spares_neutral_mentions():
    """Where a term goes with toxic labels by chance, the penalty lowers false positives on neutral sentences that hold it."""
    r = random.Random(3)
    words = [f"w{i}x".encode() for i in range(150)]
    texts = []
    for i in range(900):
        toxic = i % 3 == 0
        own = r.choices(words, k=12) + [r.choice([b"scum", b"vermin", b"filth"])] * (toxic and r.random() < 0.8) + [b"muslim"] * (r.random() < (0.6 if toxic else 0.05))
        texts.append((int(toxic), b" ".join(own)))
    rows = sorted((y, toxicity._packed(toxicity.words(t))) for y, t in texts)
    swaps = [(toxicity._packed(a), toxicity._packed(b)) for _, t in texts for a, b in toxicity.counterfactuals(t)]
    neutral = [toxicity._packed(set(r.choices(words, k=12)) | {b"muslim"}) for _ in range(200)]
    insults = [toxicity._packed(set(r.choices(words, k=12)) | {b"scum"}) for _ in range(200)]

    def rate(sentences, fairness):
        weights, bias = toxicity.fit(rows, swaps, fairness=fairness)
        return (toxicity.Rows([np.frombuffer(x, "<u4") for x in sentences]).scores(weights, bias) >= 0.5).mean()

    assert rate(neutral, 0.0) > 0.6 and rate(neutral, 5.0) < 0.35
    assert rate(insults, 5.0) > 0.9


def edited(r, line, n):
    x = list(line)
    for _ in range(n):
        i = r.randrange(len(x))
        x[i : i + 1] = r.choice([[], [r.choice("abcd")], [x[i], r.choice("abcd")]])
    return "".join(x)


def test_edit_join_long_lines(spark):
    r = random.Random(8)
    lines = ["c" + "".join(r.choice("abcdefgh ") for _ in range(n)) + "c" for n in (75, 119, 160, 240, 350, 350, 700)]
    lines += [edited(r, x[1:-1], n) for x in lines for n in (2, 3, len(x) // 30, len(x) // 20, len(x) // 12)]
    far = "".join(r.choice("abcdefgh ") for _ in range(1600))
    even = [far[: at * 20] + "".join("z" if i % 20 == 19 else c for i, c in enumerate(far))[at * 20 :] for at in (0, 40)]  # edits as far apart as can be
    lines += [far + "e", *[x + "e" for x in even]]
    d = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id long, text string")
    links = Counter()
    for i, a in enumerate(lines):
        for b in lines[:i]:
            t = min(len(a), len(b)) // 20
            if abs(len(a) - len(b)) <= t and distance(a, b) <= t:
                links.update([a, b])
    assert sum(v > 0 for v in links.values()) > 20
    assert {r.doc_id: r.n_links for r in line_join.line_report(d).collect()} == {i: links[x] for i, x in enumerate(lines)}


def test_near_duplicate_groups(spark):
    r = random.Random(9)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(900)]
    common, texts = [r.choice(vocabulary) for _ in range(30)], [None, "", " ", "one two", "one  two"]
    for i in range(40):
        w = [r.choice(vocabulary) for _ in range(r.randint(30, 150))] + common * (i % 3 == 0)
        texts.append(" ".join(w))
        for _ in range(4):  # copies with words replaced, some of the copy before: similarities on both sides of 0.8
            x = list(w)
            for at in r.sample(range(len(x)), r.randint(1, max(1, len(x) // 30))):
                x[at] = "new"
            texts.append(" ".join(x))
            w = x if i % 2 else w
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5)) for t in texts]
    group = list(range(len(texts)))
    alike = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if len(x & y) >= 0.8 * len(x | y):
                alike += 1
                a, b = sorted((group[i], group[j]))
                group = [a if g == b else g for g in group]
    assert alike > 60 and len(set(group)) > 60
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {row.doc_id for row in simhash.without_near_duplicates(d).collect()} == {i for i, g in enumerate(group) if i == g}


def test_edited_passages(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(5)) for _ in range(3000)]
    texts = []
    for n in (40, 45, 50, 60) * 15:
        passage = [r.choice(vocabulary) for _ in range(n)]
        for _ in range(2):
            x = [r.choice(vocabulary) if r.random() < 0.06 else w for w in passage]
            texts.append(" ".join([r.choice(vocabulary) for _ in range(r.randint(5, 60))] + x + [r.choice(vocabulary) for _ in range(r.randint(5, 60))]))
    expected = set()
    for i in range(0, len(texts), 2):
        a, b = (passage_chains.Text(t.encode()) for t in texts[i : i + 2])
        if any(passage_chains.passages(c, a, b) for c in passage_chains.chains(passage_chains.matches(a.places(), b))):
            expected.add((i, i + 1))
    assert len(expected) > 30
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(sorted((x.doc_id, x.other_id))) for x in passage_chains.shared_passages(d).collect()} == expected


def test_pipeline(spark, docs, tmp_path):
    """Each stage of run against its plain rule on its own input: cleaned lines, repeated lines, near duplicates, mixing, ids."""
    import corpus_pipeline

    r = random.Random(21)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(700)]
    sentence = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    rows = []
    for i in range(30):
        rows.append((i, "\n".join(sentence(r.randint(9, 16)) for _ in range(5)), "en", f"s{i % 4}", 1, "x", 7))
    base = rows[3][1]
    rows += [(40, base, "en", "s1", 1, "x", 7), (41, base.replace(base.split()[-1], "zzz."), "en", "s2", 1, "x", 7), (42, None, "en", None, 1, "x", 7), (43, "home menu login", "en", "s1", 1, "x", 7), (None, rows[5][1] + sentence(12), "en", "s0", 1, "x", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _node string, times long")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    state = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, state, str(tmp_path)).cache()
        before, after = state.collect(), out.collect()
        if name != "sentencepiece":
            assert out.columns == table.columns
        if name == "quality_rules":
            kept = {x.doc_id for x in quality_rules.quality_report(state).where("kept").collect()}
            assert {x.doc_id for x in after} == kept and kept >= set(range(30)) and not kept & {42, 43}
        elif name == "line_dedup":
            seen = [x for d in sorted(before, key=lambda d: (d.doc_id is None, d.doc_id or 0)) for x in d.text.split("\n")]
            first = [x for i, x in enumerate(seen) if not any(abs(len(x) - len(y)) <= line_join.edits(min(len(x), len(y))) and distance(x, y) <= line_join.edits(min(len(x), len(y))) for y in seen[:i])]
            assert Counter(x for d in after for x in d.text.split("\n")) == Counter(first)
        elif name == "simhash_near_dedup":
            sets = {d.doc_id: set(simhash.shingle_hashes(d.text.encode(), 5)) for d in before if d.doc_id is not None}
            least = grouped([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
            assert {d.doc_id for d in after} - {None} == set(least.values())
        elif name == "mixing":
            times = Counter({(x.doc_id, x.source): x.times for x in mixing.mix(state).collect() if x.times})
            assert Counter((d.doc_id, d.source) for d in after) == times
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            want = Counter((d.doc_id, zlib.crc32(np.array(library.encode(d.text or ""), "<u4").tobytes())) for d in before)
            assert Counter((d.doc_id, d.ids_crc32) for d in after) == want and all(d.exact for d in after)
        state = out
    assert Counter(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(str, state.collect()))


def test_pipeline_compares_fingerprints(spark, monkeypatch):
    """The stage joins SimHash fingerprints; what they find and what they miss is checked by the sets."""
    r = random.Random(5)
    words = [" ".join(f"w{r.randrange(500)}" for _ in range(150)) for _ in range(30)]
    texts = [*words, *[w.rsplit(" ", 1)[0] + " end" for w in words]]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    join = simhash.similar_pairs
    monkeypatch.setattr(simhash, "similar_pairs", lambda fps, budget: asked.append(budget) or join(fps, budget))
    assert {x.doc_id for x in simhash.without_near_duplicates(d).collect()} == set(range(30)) and asked == [3]
    fp = [simhash.fingerprint(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    close = {(i, j) for j in range(60) for i in range(j) if (fp[i] ^ fp[j]).bit_count() <= 3}
    found = simhash.fingerprint_candidates(d.selectExpr("doc_id AS node", "CAST(text AS BINARY) AS text"), 5, 3)
    assert {(x.a, x.b) for x in found.collect()} == close and len(close) > 5


def test_all_linked_passages_come_together(spark):
    """200 texts hold the same three strings; only two of them agree in the words between, in runs too short for seeds."""
    r = random.Random(31)
    filler = lambda n: [f"v{r.randrange(10**9)}" for _ in range(n)]
    common, between = [[f"c{k}{i}" for i in range(9)] for k in range(3)], [filler(8), filler(8)]
    texts = []
    for i in range(200):
        gaps = [[*filler(1), *g[:4], *filler(1), *g[4:], *filler(1)] if i in (70, 141) else filler(11) for g in between]
        texts.append(" ".join([*filler(6), *common[0], *gaps[0], *common[1], *gaps[1], *common[2], *filler(5)]))
    a, b = (passage_chains.Text(texts[i].encode()) for i in (70, 141))
    assert any(passage_chains.passages(c, a, b) for c in passage_chains.chains(passage_chains.matches(a.places(), b)))
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert not passage_chains.shared_passages(d, exhaustive=False).collect()
    assert {frozenset((x.doc_id, x.other_id)) for x in passage_chains.shared_passages(d).collect()} == {frozenset((70, 141))}


def test_seeds_go_packed():
    # 1,000 lines of 300 characters with one edit each in a copy: a seed cost 26 bytes of shuffle as a row
    r = random.Random(5)
    lines = ["".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(500)]
    lines += [x[:150] + "#" + x[151:] for x in lines]
    table = pa.table({"src": pa.array(np.zeros(len(lines), np.int32)), "lid": pa.array(np.arange(len(lines))), "line": pa.array(lines)})
    packed = pa.Table.from_batches(line_join._pack_lines(table.to_batches()))
    keys = line_join._keys(1, 40)((pa.scalar(0),), packed)
    found = line_join._shared_seeds(1, 40)((pa.scalar(0),), packed, pa.Table.from_batches(shared_keys._meet(keys).to_batches()))
    rows = sum(len(line_join._numbers(x)) for x in found["line"].to_pylist())
    assert rows > 20_000 and found.nbytes < 14 * rows
    pairs = [t for x in line_join._tables(line_join._pairs(found)["rows"]) for t in zip(x["a"].to_pylist(), x["b"].to_pylist())]
    assert {(i, i + 500) for i in range(500)} <= set(pairs) and len(set(pairs)) == len(pairs)


def test_pairs_measured_together():
    """Many pairs at once as one by one, with characters of all widths, no room to edit, and few long pairs among many."""
    r = random.Random(5)
    pairs = []
    for k in range(900):
        symbols = "abcde" if k % 2 else "ab cdé🙂￿￾�"
        v = "".join(r.choice(symbols) for _ in range(r.randint(20, 100) if k % 50 else 4000))
        w = list(v)
        for _ in range(r.randint(0, 8)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", *symbols])
        pairs.append((v, "".join(w), line_join.edits(min(len(v), len(w)))))
    got = line_join.alike(*map(list, zip(*pairs))).tolist()
    assert got == [line_join.within(*p) for p in pairs] and 100 < sum(got) < 800


def test_written_steps_leave_no_shuffle_files(spark):
    """A written table or a checkpoint lets its shuffle files go, and the session keeps its setting."""
    import time

    from precinctlab.llm.common import bucketed, cut

    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    frame = lambda: spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(4, "k")
    shuffles = lambda: {b for b in blocks.getAllBlocks().mkString(" ").split() if b.startswith("shuffle")}
    before, end = shuffles(), time.time() + 10
    bucketed(frame(), 4, "k"), cut(frame())
    while shuffles() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffles() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_lines_are_sent_in_turns(spark, monkeypatch):
    """Sources take turns when pairs are many, and the links are those of one turn."""
    r = random.Random(8)
    base = ["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(12)]
    rows = [(i, "\n".join(x[:k] + r.choice("xyz") + x[k + 1 :] for x in r.sample(base, 3) for k in [r.randrange(60)])) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    get = lambda: sorted(map(tuple, line_join.line_classes(d).select("lid", "class_id", "n_links").collect()))
    cuts, cut = [], line_join.cut
    monkeypatch.setattr(line_join, "cut", lambda df: cuts.append(1) or cut(df))
    monkeypatch.setattr(line_join, "SOURCE", 2000)
    whole, turns = get(), len(cuts)
    monkeypatch.setattr(line_join, "TURN", 100)
    assert get() == whole and any(n for _, _, n in whole) and len(cuts) - turns > turns


def test_encoder_on_odd_spaces():
    """Ids of the library whatever white space stands beside a space; chunks of texts that go whole are not remembered."""
    r, own = random.Random(3), token_output.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["".join(r.choice([" ", " ", "a", "b", "\n", "\t", "　", "é", "'s", "1", "x" * 70, "\x1c", "\x85", "."]) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    got = [x for at in range(0, len(texts), 500) for x in own.encode(texts[at : at + 500])]
    assert got == [np.array(x.ids, "<u4").tobytes() for x in own.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert own.known and not any(x[:1].isspace() or x[-1:].isspace() or not x or len(x) > token_output.LONG for x in own.known)
    assert own.held == sum(len(x) + len(ids) + 160 for x, ids in own.known.items())


def test_texts_of_pairs_go_in_turns(spark, monkeypatch):
    """Texts of all pairs at once took several times the disk that the table takes."""
    texts = {i: " ".join(f"w{j}" if j % 12 or i % 3 else f"x{i}" for j in range(60)) for i in range(9)}
    table = spark.createDataFrame([(i, t.encode()) for i, t in texts.items()], "node long, text binary")
    pairs = [(a, b) for a in texts for b in texts if a < b]
    turns = []
    monkeypatch.setattr(simhash, "cut", lambda df: turns.append(df.cache()) or turns[-1])
    got = simhash._linked(spark.createDataFrame(pairs, "a long, b long"), table, len(texts), 5, 0.8)
    sets = {i: set(simhash.shingle_hashes(t.encode(), 5)) for i, t in texts.items()}
    want = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 0 < len(want) < len(pairs) and sorted(map(tuple, got.collect())) == sorted(want)
    assert len(turns) == len(pairs) / (simhash.TURN * len(texts))


def test_pairs_of_seeds_go_in_turns(spark, monkeypatch):
    """The last round's pairs of seeds, all at once, took more disk than the check allows."""
    left = spark.createDataFrame([(h, t, 8 * h, 5, t) for h in range(6) for t in range(20)], "h long, t long, place int, span int, c long")
    turns = []
    monkeypatch.setattr(passage_chains, "FEW_SEEDS", 1)
    monkeypatch.setattr(passage_chains, "cut", lambda df: turns.append(df.cache()) or turns[-1])
    got = sorted(map(tuple, passage_chains._all_met(left).collect()))
    assert got == [(a, b) for a in range(20) for b in range(a + 1, 20)]
    assert len(turns) == 3 and all(x.count() < len(got) for x in turns)


def test_every_pair_of_one_class_comes(spark):
    """Texts that share a passage came as a pair only where nothing else linked their classes; some texts here repeat their own strings, too."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(5))
    texts, base = [], [word() for _ in range(70)]
    for i in range(14):
        x = [word() if r.random() < 0.05 else w for w in base]
        x = x[: 20 + 5 * i] if i % 3 == 0 else x[i:]
        x = [*x, *(word() for _ in range(9)), *x[: 7 * (i % 4)], *(word() for _ in range(4)), *x[3 : 3 * (i % 5)]]
        texts.append(" ".join(x))
    read = [passage_chains.Text(t.encode()) for t in texts]
    spans = {(i, j): {p for c in passage_chains.chains(passage_chains.matches(read[i].places(), read[j])) for p in passage_chains.passages(c, read[i], read[j])} for i in range(14) for j in range(14) if i != j}
    want = {frozenset(k) for k, p in spans.items() if p}
    got = passage_chains.shared_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(want) > 40 and {frozenset((x.doc_id, x.other_id)) for x in got} == want
    assert len({x.class_id for x in got}) == 1
    assert all((x.start, x.end, x.other_start, x.other_end, x.n_equal) in spans[x.doc_id, x.other_id] for x in got)


def test_runs_of_seeds_take_two_rows(spark):
    """Of seeds in a row in both texts the first and the last make rows of a pair, except beside repeated ones."""
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(x) for x in (words, ["x", *words, "y"], [*words[:30], "z", *words[30:]], [*words, *words[5:11]])]
    table = pa.table({"t": list(range(4)), "text": [t.encode() for t in texts]})
    keys = pa.table({"keys": pa.array([], pa.binary())})
    rows = passage_chains._shared_seeds(64)((0,), table, keys).to_pylist()
    at = {(x["t"], x["h"]): x for x in rows}
    edges = Counter()
    for x in rows:
        for t in range(x["t"] + 1, 4):
            y = at.get((t, x["h"]))
            if y:
                begins, ends = (x[c] == 0 or x[c] != y[c] for c in ("before", "after"))
                edges[x["t"], t] += begins or ends
    assert edges[0, 1] == 2 and edges[0, 2] == 4 and edges[1, 2] == 4
    assert 4 <= edges[0, 3] <= 8  # two strings come twice, with neighbours on both sides
    cols = "h long, t long, place int, span int, before long, after long"
    seeds = spark.createDataFrame([tuple(x[c.split()[0]] for c in cols.split(", ")) for x in rows], cols)
    plain = passage_chains._all_met(seeds.select("h", "t", "place", "span"))
    assert sorted(map(tuple, passage_chains._all_met(seeds).collect())) == sorted(map(tuple, plain.collect())) == [(a, b) for a in range(4) for b in range(a + 1, 4)]


def test_links_of_near_copies_come_by_blocks(spark, monkeypatch):
    """A row for each link of 200 near copies made 19,900 rows, and the lines lay in as many sources as there are."""
    r = random.Random(21)
    base = "".join(r.choice("abcdefgh ") for _ in range(120))
    lines = [base, *(base[:k] + "X" + base[k + 1 :] for k in range(0, 100)), *(base[:k] + "YZ" + base[k:] for k in range(1, 100))]
    lids = list(range(len(lines)))
    placed = pa.Table.from_batches(line_join._placed(50)(pa.table({"lid": lids, "line": lines}).to_batches()))
    assert Counter(placed["src"].to_pylist()).most_common(1)[0][1] > 100 and placed["line"].to_pylist() == lines
    made, cut = [], line_join.cut
    monkeypatch.setattr(line_join, "cut", lambda df: made.append(cut(df)) or made[-1])
    got = line_join.line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    want = {x: sum(line_join.within(x, y, line_join.edits(min(len(x), len(y)))) for y in lines) - 1 for x in lines}
    assert sorted(x.n_links for x in got) == sorted(want.values()) and len({x.class_id for x in got}) == 1
    assert sum(t.count() for t in made) < 1000 < sum(want.values()) / 2
