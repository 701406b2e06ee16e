"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of a word's tree hold the merge ranks of its adjacent symbol pairs, an
inner node the smaller of its children; rank and place share one number, so the
root is the leftmost pair of lowest rank. A merge rewrites at most three leaves,
each with logarithmic cost, until no pair can be merged. Trees of short words
are built for many words at once as rows of one array; a long word has its own.

Texts split at white space without changing the result, so each task encodes a
distinct chunk once and keeps a bounded number of them. The vocabulary is read
on the driver and shipped (49k entries here; its size is checked).

Nulls: a null text is empty and has no tokens. Repeated rows give repeated
results; an empty table gives an empty one. Of equal ranks the leftmost pair
merges first. Very long texts are encoded whole, a long word by a tree of its own
in logarithmic steps. Only the id and text columns are read; further columns,
whatever their names, change nothing and aren't returned.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import MAX_BROADCAST_BYTES, released, slices

#: Code points that separate words (Unicode White_Space).
SPACE = "\t-\r \x85\xa0  -     　"
#: What the library splits words with, after lower-casing.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
CHUNK = regex.compile(rf"[^{SPACE}]+")
#: Python's split() also cuts at these; they are ordinary characters here.
ODD = regex.compile("[\x1c-\x1f]")
END = "</w>"
NONE = np.int64(1) << 60
#: Words with more pairs have their own tree.
WIDE = 64
CACHE = 320_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + n)
            n += 1
    return [letters[b] for b in range(256)]


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + END] for c in letters], dtype=np.int64)
        pairs = np.array([(ids[a] << 32) | ids[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.ranks = pairs[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        if len(self.tokens) * 200 > MAX_BROADCAST_BYTES:
            raise ValueError("the vocabulary is too large to ship to every task")

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs, NONE where there is no merge."""
        key = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.ranks[at], NONE)

    def symbols(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, dtype=np.uint8)
        out = self.inner[raw]
        out[-1] = self.last[raw[-1]]
        return out


def merge_rows(v: Vocabulary, words: list[bytes], leaves: int) -> list[np.ndarray]:
    """The merged symbols of words with at most ``leaves`` pairs (a power of two)."""
    n, wide = len(words), leaves + 2
    length = np.array([len(w) for w in words])
    raw = np.zeros((n, wide), dtype=np.uint8)
    raw[np.arange(wide) < length[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
    sym = v.inner[raw]
    rows = np.arange(n)
    sym[rows, length - 1] = v.last[raw[rows, length - 1]]
    place = np.arange(leaves)
    tree = np.full((n, 2 * leaves), NONE, dtype=np.int64)
    first = v.rank(sym[:, :leaves], sym[:, 1 : leaves + 1])
    tree[:, leaves:] = np.where((first < NONE) & (place < length[:, None] - 1), first * leaves + place, NONE)
    half = leaves
    while half > 1:
        tree[:, half // 2 : half] = np.minimum(tree[:, half : 2 * half : 2], tree[:, half + 1 : 2 * half : 2])
        half //= 2
    after = np.broadcast_to(np.arange(1, wide + 1), (n, wide)).copy()
    before = after - 2
    live = np.broadcast_to(np.arange(wide), (n, wide)) < length[:, None]

    def update(r: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        at = leaf + leaves
        tree[r, at] = value
        while leaves > 1 and at[0] > 1:  # all leaves have the same depth
            at = at >> 1
            tree[r, at] = np.minimum(tree[r, 2 * at], tree[r, 2 * at + 1])

    def pair(r: np.ndarray, left: np.ndarray) -> np.ndarray:
        right = after[r, left]
        ok = right < length[r]
        rank = v.rank(sym[r, left], sym[r, np.where(ok, right, 0)])
        return np.where(ok & (rank < NONE), rank * leaves + left, NONE)

    r = rows
    while len(r := r[tree[r, 1] < NONE]):
        rank, at = np.divmod(tree[r, 1], leaves)
        gone = after[r, at]
        sym[r, at] = v.merged[rank]
        live[r, gone] = False
        after[r, at] = nxt = after[r, gone]
        inside = nxt < length[r]
        before[r[inside], nxt[inside]] = at[inside]
        here = gone < leaves
        if here.any():
            update(r[here], gone[here], np.full(here.sum(), NONE))
        update(r, at, pair(r, at))
        left = before[r, at]
        has = left >= 0
        if has.any():
            update(r[has], left[has], pair(r[has], left[has]))
    return [sym[i, live[i]] for i in range(n)]


def merge_long(v: Vocabulary, word: bytes) -> np.ndarray:
    """The merged symbols of one word, with a tree of its own."""
    sym = v.symbols(word).tolist()
    n = len(sym)
    leaves = 1 << (n - 1).bit_length()
    first = v.rank(np.array(sym[:-1]), np.array(sym[1:]))
    none = int(NONE)
    tree = [none] * (2 * leaves)
    tree[leaves : leaves + n - 1] = np.where(first < NONE, first * leaves + np.arange(n - 1), NONE).tolist()
    for i in range(leaves - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = dict(zip(v.pairs.tolist(), v.ranks.tolist(), strict=True))
    merged = v.merged.tolist()

    def update(leaf: int, value: int) -> None:
        at = leaf + leaves
        tree[at] = value
        while at > 1:
            at >>= 1
            value = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == value:
                return
            tree[at] = value

    def pair(left: int) -> int:
        right = after[left]
        rank = ranks.get((sym[left] << 32) | sym[right]) if right < n else None
        return none if rank is None else rank * leaves + left

    while tree[1] < none:
        rank, at = divmod(tree[1], leaves)
        gone = after[at]
        sym[at], sym[gone] = merged[rank], -1
        after[at] = after[gone]
        if after[gone] < n:
            before[after[gone]] = at
        update(gone, none)
        update(at, pair(at))
        if before[at] >= 0:
            update(before[at], pair(before[at]))
    return np.array([s for s in sym if s >= 0])


def encode_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    """The ids of each word, given as UTF-8."""
    out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) == 1:
            out[i] = v.symbols(w)
        elif len(w) - 1 > WIDE:
            out[i] = merge_long(v, w)
        else:
            by_size.setdefault(1 << (len(w) - 2).bit_length(), []).append(i)
    for leaves, members in by_size.items():
        step = max(256, 200_000 // leaves)
        for k in range(0, len(members), step):
            part = members[k : k + step]
            for i, ids in zip(part, merge_rows(v, [words[i] for i in part], leaves), strict=True):
                out[i] = ids
    return out


class Encoder:
    """Encodes texts; keeps at most CACHE chunks."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.known: dict[str, tuple[bytes, str]] = {}
        self.past: dict[str, tuple[bytes, str]] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(v.special, key=len, reverse=True)) + ")") if v.special else None

    def chunks(self, text: str) -> list[str]:
        if self.split and any(s in text for s in self.v.special):
            parts = self.split.split(text)
            return [c for i, p in enumerate(parts) for c in ([p] if i % 2 else self._cut(p))]
        return self._cut(text)

    @staticmethod
    def _cut(text: str) -> list[str]:
        return CHUNK.findall(text) if ODD.search(text) else text.split()

    def learn(self, chunks: Iterable[str]) -> None:
        """Encodes the chunks that are not known yet, all at once."""
        new = []
        for c in chunks:
            if c not in self.known:
                if (found := self.past.get(c)) is None:
                    new.append(c)
                else:
                    self.known[c] = found
        if not new:
            return
        pieces: list[list[bytes]] = []
        for c in new:
            if c in self.v.special:
                pieces.append([])
                continue
            plain = unicodedata.normalize("NFC", c).replace("Σ", "σ").lower() if not c.isascii() else c.lower()
            pieces.append([p.encode("utf-8", "replace") for p in PIECE.findall(plain)])
        words = list(dict.fromkeys(w for p in pieces for w in p))
        ids = dict(zip(words, encode_words(self.v, words), strict=True))
        for c, p in zip(new, pieces, strict=True):
            own = [self.v.special[c]] if c in self.v.special else [i for w in p for i in ids[w].tolist()]
            self.known[c] = np.array(own, dtype="<u4").tobytes(), self.decode(own)

    def decode(self, ids: Iterable[int]) -> str:
        """The file has no decoder: tokens joined by a space."""
        return " ".join([self.v.tokens[i] for i in ids])

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        cut = [self.chunks(t) for t in texts]
        if len(self.known) > CACHE // 2:  # frequent chunks come back from the past
            self.past, self.known = self.known, {}
        self.learn(dict.fromkeys(c for part in cut for c in part))
        known = self.known
        for part in cut:
            found = [known[c] for c in part]
            yield b"".join([f[0] for f in found]), " ".join([f[1] for f in found])


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, group: int = 256) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256), with ``keep_ids`` also ids and decoded."""
    shipped = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(shipped.value)
        for batch in batches:
            for part in slices(batch, 1, group):
                rows = list(enc.encode([t or "" for t in part.column(1).to_pylist()]))
                cols = [
                    part.column(0),
                    pa.array([len(i) // 4 for i, _ in rows], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in rows], pa.string()),
                    pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in rows], pa.string()),
                ]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.array([np.frombuffer(i, "<u4").tolist() for i, _ in rows], pa.list_(pa.int64())), pa.array([d for _, d in rows], pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(released(run), schema)
