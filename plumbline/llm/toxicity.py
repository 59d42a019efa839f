"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text. Both begin with the same base (trained on ordinary words), so
that these compress alike with either; the toxic one goes on with all segments of words that toxic documents hold several
times as often as ordinary ones, which the base leaves out. Each word is a frame of its
own, so its two lengths depend on nothing else and a worker remembers them; the compression lengths of a window are the
sums over its ``window`` words. Windows count where the ordinary length exceeds the toxic one by a threshold calibrated on
documents that trained neither dictionary, and a logistic curve, fitted on the same ones, turns the counts into a score.

Training reads at most ``train_docs`` labelled documents and ``train_chars`` code points of each class, taken in the
order of a hash of doc_id: of each document the beginning, up to a sixteenth of all, and a document that does not fit
into what is left is passed over. Scoring reads whole texts.

Defined cases: a NULL or empty text has no windows and gets the score of no evidence; a NULL doc_id is not held out and
never trains; repeated label rows train once; a NULL label does not train; without documents of both classes every score
is the share of toxic labels (0 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, text_column

GRAM = 5  # bytes
STEPS = 4  # thresholds


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").split()


def _grams(data: bytes) -> np.ndarray:
    x = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    if len(x) < GRAM:
        return np.empty(0, np.int64)
    key = np.zeros(len(x) - GRAM + 1, dtype=np.int64)
    for i in range(GRAM):
        key = key << 8 | x[i : len(key) + i]
    return key


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted byte 5-grams of the texts, words led and followed by one space, how often each is and in how many texts."""
    each = [np.unique(_grams(b" " + b" ".join(words(t)) + b" "), return_counts=True) for t in texts]
    grams, at = np.unique(np.concatenate([np.empty(0, np.int64), *[g for g, _ in each]]), return_inverse=True)
    times = np.concatenate([np.empty(0, np.int64), *[n for _, n in each]])
    return grams, np.bincount(at, weights=times, minlength=len(grams)), np.bincount(at, minlength=len(grams))


def telling(texts: list[str], others: list[str], ratio: float, min_docs: int = 3, min_share: float = 0.03) -> np.ndarray:
    """Sorted byte 5-grams that occur ``ratio`` times as often in the texts as in the same amount of other text, or more,
    in ``ratio`` / 2 times the share of documents, and in enough of them. Two occurrences are added to the expected ones
    and half a document to each count: a few chance ones neither make nor exclude a gram."""
    (own, n, docs), (grams, m, other_docs) = gram_counts(texts), gram_counts(others)
    there, in_others = np.zeros(len(own)), np.zeros(len(own))
    if len(grams) and len(own):
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        same = grams[at] == own
        there, in_others = np.where(same, m[at], 0) * (n.sum() / m.sum()), np.where(same, other_docs[at], 0)
    lift = (docs + 0.5) / (len(texts) + 1) * (len(others) + 1) / (in_others + 0.5)
    return own[(docs >= max(min_docs, min_share * len(texts))) & (n >= ratio * (there + 2)) & (lift >= ratio / 2)]


def segments(texts: list[str], others: list[str], size: int, ratio: float, min_docs: int = 3) -> list[bytes]:
    """Dictionary content: segments of words whose byte 5-grams are all telling, those in most documents last (zstandard
    reaches the end of a dictionary most cheaply)."""
    known = telling(texts, others, ratio, min_docs)
    if not len(known):
        return []
    cut: dict[bytes, list[bytes]] = {}
    docs: dict[bytes, int] = {}
    for text in texts:
        own = set()
        for word in set(words(text)):
            if word not in cut:
                line = b" " + word + b" "
                g = _grams(line)
                hit = known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                cut[word] = [line[a : b + GRAM - 1] for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
            own.update(cut[word])
        for segment in own:
            docs[segment] = docs.get(segment, 0) + 1
    out, room = [], size
    for segment in sorted((s for s, n in docs.items() if n >= min_docs), key=lambda s: (-docs[s], s)):
        if len(segment) <= room and not any(segment in o for o in out):
            out.append(segment)
            room -= len(segment)
    return out[::-1]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a trained dictionary; too few samples for training are taken as they are."""
    try:
        return zstandard.train_dictionary(size, samples, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


class Gains(dict):
    """Word -> bytes that the toxic dictionary saves over the ordinary one. Bounded: dropped together when too many."""

    def __init__(self, ordinary: bytes, toxic: bytes, limit: int = 500_000):
        super().__init__()
        self.limit = limit
        # Indexes every position of a dictionary (quicker parsers skip some) and leaves literals as they are (stronger ones code them).
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_LAZY2, min_match=GRAM, window_log=15, hash_log=15, chain_log=15, search_log=6,
            write_content_size=False, write_checksum=False, write_dict_id=False,
        )
        make = lambda d: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params).compress
        self.plain, self.toxic = make(ordinary), make(toxic)

    def __missing__(self, word: bytes) -> int:
        frame = (b" " + word + b" ") * 8  # zstandard leaves shorter blocks as they are
        gain = len(self.plain(frame)) - len(self.toxic(frame))
        if len(self) >= self.limit:
            self.clear()
        if len(word) < 200:
            self[word] = gain
        return gain


@dataclass
class Judge:
    """What scoring needs; its size is bounded by the sizes of the dictionaries."""

    ordinary: bytes
    toxic: bytes
    threshold: int
    weights: tuple[float, ...]
    window: int

    def open(self) -> Gains:
        return Gains(self.ordinary, self.toxic)

    def gains(self, text: str, of: Gains) -> np.ndarray:
        """Ordinary less toxic compression length, window by window."""
        each = np.fromiter(map(of.__getitem__, words(text)), dtype=np.int64)
        return np.add.reduceat(each, np.arange(0, len(each), self.window)) if len(each) else each

    def features(self, gains: np.ndarray) -> np.ndarray:
        """How many windows reach each step up to some above the threshold, in all and among the document's."""
        hits = np.array([(gains >= i).sum() for i in range(self.threshold, self.threshold + STEPS)], dtype=np.float64)
        return np.concatenate([[1.0], np.log1p(hits), 10 * np.minimum(0.3, hits / max(1, len(gains)))])

    def score(self, gains: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.features(gains) @ np.array(self.weights), -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.3, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (times * p * (1 - p))[:, None]) + keep, x.T @ (times * (y - p)) - keep @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learn(toxic: list[str], ordinary: list[str], share: float, *, window: int, dict_bytes: int, base_bytes: int, false_share: float, ratio: float = 4.0) -> Judge:
    """Fit on the even, calibrate on the odd documents of each class, weighted to the ``share`` of toxic labels."""
    fit_t, fit_o = toxic[::2], ordinary[::2]
    own = segments(fit_t, fit_o, dict_bytes, ratio)
    # The base is of words without toxic segments: what both dictionaries hold shows no difference.
    marked = re.compile(b"|".join(map(re.escape, own)) or b"(?!)")
    split = [[w for w in words(t) if not marked.search(b" " + w + b" ")] for t in fit_o]
    lines = [b" ".join(w[i : i + 16]) for w in split for i in range(0, len(w), 16)]
    base = dictionary(lines, base_bytes)
    judge = Judge(base, base + b"".join(own), 1, (), window)
    of = judge.open()
    held = [(judge.gains(t, of), y) for texts, y in ((toxic[1::2], 1.0), (ordinary[1::2], 0.0)) for t in texts]
    plain = np.concatenate([g for g, y in held if not y] or [np.zeros(1, np.int64)])
    # The smallest threshold that few windows of ordinary documents reach.
    while judge.threshold < 64 and (plain >= judge.threshold).mean() > false_share:
        judge.threshold += 1
    x, y = np.array([judge.features(g) for g, _ in held]), np.array([y for _, y in held])
    times = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    judge.weights = tuple(_logistic(x, y, times).tolist())
    return judge


def train(docs: DataFrame, labels: DataFrame, *, train_docs: int = 3000, train_chars: int = 6_000_000, seed: int = 11, **options) -> tuple[Judge | None, float]:
    """The judge, and the share of toxic labels among those that may train (crc32 of doc_id mod 3 is not 1)."""
    part = F.crc32(labels["doc_id"].cast("string").cast("binary")) % 3
    may = labels.filter(part != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter("toxic IN (0, 1)")
    counts = {r["toxic"]: r["n"] for r in may.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    # Sizes first, so that what is fetched is bounded: ``train_docs`` pairs of id and length for each class.
    most = max(1, train_chars // 16)
    sized = docs.select("doc_id", F.least(F.char_length(text_column(docs)), F.lit(most)).alias("size")).join(may, "doc_id")
    chosen: dict[int, list] = {}
    for toxic in (0, 1):
        rows = sized.filter(F.col("toxic") == toxic).orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "size").limit(train_docs).collect()
        chosen[toxic], room = [], train_chars
        for r in rows:
            if r["size"] <= room:
                chosen[toxic].append(r["doc_id"])
                room -= r["size"]
    if not all(len(ids) >= 8 for ids in chosen.values()):
        return None, share
    ids = {i: toxic for toxic, own in chosen.items() for i in own}
    texts = docs.filter(F.col("doc_id").isin(list(ids))).select("doc_id", F.substring(text_column(docs), 1, most).alias("text")).dropDuplicates(["doc_id"]).collect()
    by = {r["doc_id"]: r["text"] for r in texts}
    return learn(*([by[i] for i in chosen[k] if i in by] for k in (1, 0)), share, **options), share


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.7,
    window: int = 2,
    dict_bytes: int = 16384,
    base_bytes: int = 8192,
    false_share: float = 0.005,
    **bounds,
) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if the score is ``threshold`` or more) of every row."""
    judge, share = train(docs, labels, window=window, dict_bytes=dict_bytes, base_bytes=base_bytes, false_share=false_share, **bounds)
    model = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        judge = model.value
        of = judge.open() if judge else None
        for batch in slices(batches):
            scores = [judge.score(judge.gains(t, of)) if judge else share for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
