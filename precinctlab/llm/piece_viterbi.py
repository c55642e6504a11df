"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The vocabulary and ranks come from a public model file, and ids are those of
the merge rule: the pair of neighbours whose union ranks first merges first,
the leftmost of equal ones.  A text is marked (a dummy mark in front, spaces
become marks) and cut before each run of marks; no piece spans such a cut, so
words can be encoded one by one.  A task sorts the distinct marked words of its
texts, which is their trie in depth-first order: each next word keeps the
forward table of the prefix it shares with the one before and goes on from
there.  Characters that no piece covers fall back to bytes.

Forward table: a path through pieces costs nothing where two neighbours stay
apart under the merge rule, and is ruled out where they don't.  One path is left
for each prefix, the one that merging gives: piece t ends a prefix if t is its
own encoding and stays apart from the last piece of the prefix before it.

Cases: a null text is empty; an empty text has no ids and decodes to itself;
repeated rows give repeated results; long texts and words are handled whole;
a text that holds the mark itself decodes with spaces in its place; extra
columns are left aside; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_batches

MARK = "▁"
#: Bytes of words and ids that a worker remembers; beyond it, it forgets them all.  Words over LONG characters are not remembered.
MEMORY = 192 << 20
LONG = 64
#: Pairs of pieces that a worker remembers.
PAIRS = 2_000_000
_SPACED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """The vocabulary of a model file as symbols: pieces that merging can form, and characters that pieces hold."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        self.bytes_: list[int] = [-1] * 256
        self.text: list[bytes] = []
        stored: dict[str, tuple[float, int]] = {}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_[int(p[3:5], 16)] = i
                self.text.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.text.append(b"")
            else:
                if MARK in p.lstrip(MARK):
                    raise ValueError("a piece that spans words")
                stored[p] = (-model.get_score(i), i)
                self.text.append(p.encode())
        self.rank: dict[str, float] = {p: r for p, (r, _) in stored.items()}
        self.symbols: list[str] = []
        self.ids: list[int] = []
        #: When a symbol comes into being (characters: before all), and the two it is made of.
        self.born: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        number: dict[str, int] = {}
        for p in sorted({c for p in stored for c in p} | set(stored), key=len):
            parts = [p] if len(p) == 1 else self._last_merge(p)
            if len(parts) == 2 or len(p) == 1:
                number[p] = len(self.symbols)
                self.symbols.append(p)
                self.ids.append(stored[p][1] if p in stored else -1)
                self.born.append(self.rank[p] if len(p) > 1 else -math.inf)
                self.left.append(number[parts[0]] if len(p) > 1 else -1)
                self.right.append(number[parts[1]] if len(p) > 1 else -1)
        self.root: dict = {}  # trie of the symbols: children by character, the symbol itself under ""
        for k, piece in enumerate(self.symbols):
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = k
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.pairs: dict[int, bool] = {}

    def _last_merge(self, piece: str) -> list[str]:
        """The two parts that merge last into a piece; more parts if merging does not form it."""
        parts = list(piece)
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, math.inf) for a, b in zip(parts, parts[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == math.inf:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def apart(self, a: int, b: int) -> bool:
        """Whether neighbours a and b stay as they are: at no time do the symbols at their border merge.

        The merges of both are undone from the last one on.  The symbols x and y
        at the border merge if their union ranks before the next merge of x with
        its left neighbour and not after that of y with its right one.
        """
        x, y, dies_x, dies_y = a, b, math.inf, math.inf
        while True:
            r = self.rank.get(self.symbols[x] + self.symbols[y])
            if r is not None and r < dies_x and r <= dies_y:
                return False
            if self.born[x] > self.born[y]:
                x, dies_x = self.right[x], self.born[x]
            elif self.left[y] >= 0:
                y, dies_y = self.left[y], self.born[y]
            else:
                return True

    def viterbi_sorted(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each of the sorted distinct words, sharing the forward table across common prefixes.

        ``last[i]`` is the last symbol of the first i characters (-1: none that
        merges), ``back[i]`` its start.  A position's entry depends on the
        characters before it alone, so entries up to the shared length hold for
        the next word too.
        """
        root, pairs, many, ids_of = self.root, self.pairs, len(self.symbols), self.ids
        if len(pairs) > PAIRS:
            pairs.clear()
        last: list[int] = [-1]
        back: list[int] = [0]
        opened: list[list] = [[(0, root)]]  # at i: the starts from which text up to i is a prefix of some symbol, with its trie node
        out: dict[str, list[int]] = {}
        before = ""
        for word in words:
            n, shared = len(word), 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], opened[shared + 1 :]
            for i in range(shared, n):
                c = word[i]
                end, at, starts = -1, i, []
                for s, node in opened[i]:
                    node = node.get(c)
                    if node is not None:
                        starts.append((s, node))
                        k = node.get("")
                        if k is not None and end < 0:
                            x = last[s]
                            if x >= 0:
                                key = x * many + k
                                ok = pairs.get(key)
                                if ok is None:
                                    ok = pairs[key] = self.apart(x, k)
                                if not ok:
                                    continue
                            end, at = k, s
                last.append(end)
                back.append(at)
                starts.append((i + 1, root))
                opened.append(starts)
            ids, i = [], n
            while i:
                s, k = back[i], last[i]
                if k >= 0 and ids_of[k] >= 0:
                    ids.append(ids_of[k])
                else:
                    ids += [self.bytes_[x] for x in reversed(word[s:i].encode("utf-8", "surrogatepass"))]
                i = s
            out[word] = ids[::-1]
            before = word
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 16- or 32-bit integers (see ``dtype``)."""
        cut = [self.cut(t) for t in texts]
        if self.held > MEMORY:
            self.known.clear()
            self.held = 0
        new: set[str] = set()
        for w in cut:
            new.update(w)
        new.difference_update(self.known)
        known, long = self.known, {}
        for w, ids in self.viterbi_sorted(sorted(new)).items():
            data = np.array(ids, dtype=self.dtype).tobytes()
            if len(w) > LONG:
                long[w] = data
            else:
                known[w] = data
                self.held += len(w) + len(data) + 160
        return [b"".join([known[x] if x in known else long[x] for x in w] if long else [known[x] for x in w]) for w in cut]

    @property
    def dtype(self) -> str:
        return "<u2" if len(self.text) <= 1 << 16 else "<u4"

    @staticmethod
    def cut(text: str) -> list[str]:
        """Marked words of a text."""
        if not text:
            return []
        if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
            return _SPACED.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in text.split(" ")]

    def decode(self, ids: np.ndarray) -> str:
        piece = self.text
        out = b"".join([piece[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if out[:1] == " " else out


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>)."""
    text_batches(docs.sparkSession)

    def run(batches):
        p = pieces(model)
        for part in slices(batches, 512):
            ids = [np.frombuffer(x, p.dtype) for x in p.encode([t or "" for t in part.column(1).to_pylist()])]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        p = pieces(model)
        for b in slices(batches, 512):
            texts = [p.decode(np.array(x or [], dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_words (marked words), n_ids, ids_crc32 (32-bit little-endian ids), decoded_sha256, exact (decodes to the text)."""
    text_batches(docs.sparkSession)

    def run(batches):
        p = pieces(model)
        for part in slices(batches, 512):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows = []
            for t, x in zip(texts, p.encode(texts)):
                ids = np.frombuffer(x, p.dtype)
                back = p.decode(ids)
                rows.append((t.count(" ") + bool(t), len(ids), zlib.crc32(ids.astype("<u4")), hashlib.sha256(back.encode()).hexdigest(), back == t))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3]), pa.array(cols[4])],
                                             names=["doc_id", "n_words", "n_ids", "ids_crc32", "decoded_sha256", "exact"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
