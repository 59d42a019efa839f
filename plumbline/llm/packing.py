"""Lexical retrieval packing into sequences of a fixed window.

Every task turns its documents into token ids and handles them in shards, each with a BM25 inverted index over token
ids. A document is the seed of a window; its best unused neighbours in the shard fill the window greedily: those that
fit go in whole, and the best of the others is cut to fill what is left and goes on as the next seed. An open window
passes on to the task's next shard, and what is left at the end becomes sequences of power-of-two lengths, which need
no padding. Nothing is shuffled: an index covers ``shard_docs`` documents of one task.

Defined cases: a NULL text is empty, and an empty text is the end id alone; repeated rows are documents of their own;
a document longer than a window is cut into full windows first; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, text_column, trimmed

CONTROL = re.compile("[\x1c-\x1f]")  # white space to str.split, not to the tokenizer
# Lines of Latin-1 letters and single marks: lower case is all that normalizing does, and pieces are words and marks.
SIMPLE = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?\t-\r ]*")
RUN_OF_MARKS = re.compile("[.,;:!?]{2}")
MARKS = ".,;:!?"


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Memory(dict):
    """A bounded cache. When full it keeps what it has, as the frequent keys come first, and starts anew once it has
    turned away many times its size."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.refused = limit, 0

    def keep(self, key: str, value: bytes) -> None:
        if len(self) < self.limit:
            if len(key) < 200:
                self[key] = value
            return
        self.refused += 1
        if self.refused > 16 * self.limit:
            self.clear()
            self.refused = 0


#: Packs so many ids.
PACK = [struct.Struct(f"<{n}I").pack for n in range(32)]


class Pieces(Memory):
    """Normalized piece -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer, limit: int):
        super().__init__(limit)
        self.tokenize, self.letters = tokenizer.model.tokenize, byte_letters()

    def __missing__(self, piece: str) -> bytes:
        # Printable ASCII but the space stands for itself in the byte-level alphabet.
        plain = piece.isascii() and piece.isprintable() and " " not in piece
        found = [t.id for t in self.tokenize(piece if plain else piece.encode().decode("latin-1").translate(self.letters))]
        ids = PACK[len(found)](*found) if len(found) < len(PACK) else struct.pack(f"<{len(found)}I", *found)
        self.keep(piece, ids)
        return ids


class Runs(Memory):
    """White-space-free run -> its ids, through the tokenizer's own normalizer and pre-tokenizer."""

    def __init__(self, tokenizer, pieces: Pieces, limit: int):
        super().__init__(limit)
        self.norm, self.cut, self.pieces = tokenizer.normalizer, tokenizer.pre_tokenizer, pieces

    def __missing__(self, run: str) -> bytes:
        whole = self.norm.normalize_str(run)
        ids = b"".join([self.pieces[whole[a:b]] for _, (a, b) in self.cut.pre_tokenize_str(whole)])
        self.keep(run, ids)
        return ids


class Ids:
    """Text -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and no piece spans it, so a text's ids are those of its lines and of their runs.
    Simple lines are cut into pieces here, the runs of others by the tokenizer. Pieces are encoded by its model, once.
    """

    def __init__(self, name: str, limit: int):
        import json

        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        with open(path, encoding="utf-8") as file:
            special = {x["content"]: x["id"] for x in json.load(file)["added_tokens"]}
        tokenizer = Tokenizer.from_file(path)
        self.pieces = Pieces(tokenizer, limit)
        self.runs = Runs(tokenizer, self.pieces, limit // 4)
        self.special = {k: struct.pack("<I", v) for k, v in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def _plain(self, text: str) -> bytes:
        piece, run, out = self.pieces.__getitem__, self.runs.__getitem__, []
        for line in text.split("\n"):
            if SIMPLE.fullmatch(line) and not RUN_OF_MARKS.search(line):
                line = line.lower()
                for mark in MARKS:
                    if mark in line:
                        line = line.replace(mark, f" {mark} ")
                out += map(piece, line.split())
            else:
                out += map(run, [line] if CONTROL.search(line) else line.split())
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.split is not None and any(s in text for s in self.special):
            return b"".join(self.special[p] if p in self.special else self._plain(p) for p in self.split.split(text))
        return self._plain(text)


class Index:
    """BM25 over the documents of one shard; terms are token ids."""

    def __init__(self, docs: list[np.ndarray], k1: float = 1.2, b: float = 0.75):
        length = np.array([len(d) for d in docs], dtype=np.float64)
        # (document, term) pairs, sorted: equal ones are a term's count
        pairs = np.sort(np.repeat(np.arange(len(docs), dtype=np.int64), [len(d) for d in docs]) << 32 | np.concatenate(docs))
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        tf = np.diff(np.concatenate([first, [len(pairs)]])).astype(np.float64)
        doc, terms = pairs[first] >> 32, pairs[first] & 0xFFFFFFFF
        self.starts = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.terms, place = np.unique(terms, return_inverse=True)
        df = np.bincount(place, minlength=len(self.terms))
        idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
        weight = idf[place] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / max(1.0, length.mean())))
        order = np.argsort(place, kind="stable")
        self.place, self.weight, self.n = place, weight, len(docs)
        self.docs, self.postings, self.at = doc[order], weight[order], np.concatenate([[0], np.cumsum(df)])

    def scores(self, seed: int, terms: int) -> np.ndarray:
        """Scores of all documents for the seed's ``terms`` weightiest terms."""
        low, high = self.starts[seed], self.starts[seed + 1]
        own = self.place[low:high]
        if len(own) > terms:
            own = own[np.argpartition(-self.weight[low:high], terms)[:terms]]
        runs = [slice(self.at[t], self.at[t + 1]) for t in own.tolist()]
        if not runs:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.docs[r] for r in runs]), weights=np.concatenate([self.postings[r] for r in runs]), minlength=self.n)


class Packer:
    """Windows under construction. ``out`` gets (document, start, ids, sequence, offset)."""

    def __init__(self, window: int, first: int):
        self.window, self.sequence, self.open, self.filled, self.out = window, first, [], 0, []

    def put(self, doc, start: int, ids: bytes) -> None:
        self.open.append((doc, start, ids))
        self.filled += len(ids) // 4
        if self.filled == self.window:
            self.close()

    def close(self) -> None:
        at = 0
        for doc, start, ids in self.open:
            self.out.append((doc, start, ids, self.sequence, at))
            at += len(ids) // 4
        self.sequence += 1
        self.open, self.filled = [], 0

    def finish(self) -> None:
        """The open window as sequences of power-of-two lengths, largest first."""
        rest, left = self.open, self.filled
        self.open, self.filled = [], 0
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc, start, ids = rest.pop(0)
                take = min(room, len(ids) // 4)
                self.open.append((doc, start, ids[: 4 * take]))
                room -= take
                if 4 * take < len(ids):
                    rest.insert(0, (doc, start + take, ids[4 * take :]))
            self.close()

    def shard(self, docs: list[tuple], terms: int) -> None:
        """All documents (document, ids), each as a seed or as a neighbour."""
        index = Index([np.frombuffer(ids, dtype="<u4") for _, ids in docs])
        used, tokens = np.zeros(len(docs), dtype=bool), np.array([len(ids) // 4 for _, ids in docs])
        waiting = 0
        while True:
            while waiting < len(docs) and used[waiting]:
                waiting += 1
            if waiting == len(docs):
                return
            seed, start = waiting, 0
            while seed is not None:
                used[seed] = True
                doc, ids = docs[seed]
                while (left := int(tokens[seed]) - start) >= (room := self.window - self.filled):
                    self.put(doc, start, ids[4 * start : 4 * (start + room)])
                    start += room
                if left:
                    self.put(doc, start, ids[4 * start :])
                seed, start = self.neighbours(index, docs, used, tokens, seed, terms) if self.filled else (None, 0)

    def neighbours(self, index: Index, docs: list[tuple], used: np.ndarray, tokens: np.ndarray, seed: int, terms: int):
        """Fill the open window; (document to go on with, its tokens already packed), or (None, 0)."""
        free = np.flatnonzero(~used)
        if not len(free):
            return None, 0
        order = free[np.argsort(-index.scores(seed, terms)[free], kind="stable")]
        room = self.window - self.filled
        sizes = tokens[order]
        at = 0
        while room and at < len(order):
            fits = sizes[at:] <= room
            first = int(fits.argmax())
            if not fits[first]:
                break
            at += first
            doc, ids = docs[order[at]]
            used[order[at]] = True
            self.put(doc, 0, ids)
            room -= int(sizes[at])
            at += 1
        left = order[~used[order]]
        return (int(left[0]), 0) if room and len(left) else (None, 0)


_WORKER: dict[tuple, Ids] = {}


def pack(
    docs: DataFrame,
    *,
    vocabulary: str = "word_bpe_49k.json",
    end_id: int = 1,
    window: int = 2048,
    shard_docs: int = 1024,
    terms: int = 32,
    cached: int = 1_000_000,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``shard_docs`` is the reach of the retrieval, ``terms`` the length of a query to the index; every token is packed.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    end = struct.pack("<I", end_id)

    def run(batches):
        key = (vocabulary, cached)
        if key not in _WORKER:
            _WORKER[key] = Ids(vocabulary, cached)
        encode = _WORKER[key].encode
        packer, held, tokens = Packer(window, TaskContext.get().partitionId() << 36), [], 0

        def rows():
            out, packer.out = packer.out, []
            for at in range(0, len(out), 4096):
                part = out[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([p[0][0] for p in part], id_type),
                        pa.array([p[1] for p in part], pa.int64()),
                        pa.array([len(p[2]) // 4 for p in part], pa.int64()),
                        pa.array([p[2] for p in part], pa.binary()),
                        pa.array([p[0][1] for p in part], pa.int64()),
                        pa.array([p[3] for p in part], pa.int64()),
                        pa.array([p[4] for p in part], pa.int64()),
                    ],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        id_type = None
        for batch in slices(batches, 128):
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text) + end
                held.append(((doc_id, len(ids) // 4), ids))
                tokens += len(ids) // 4
                if len(held) >= shard_docs or tokens >= 4 * shard_docs * window:
                    packer.shard(held, terms)
                    held, tokens = [], 0
                    yield from rows()
        if held:
            packer.shard(held, terms)
        packer.finish()
        if id_type is not None:
            yield from rows()

    return docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(trimmed(run), schema)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
