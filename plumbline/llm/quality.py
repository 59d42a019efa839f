"""Quality rules with an n-gram perplexity band per language.

A character model of order four is trained on all documents, one for each value of lang: n-grams are combined in the
tasks, summed by Spark, and interpolated modified Kneser-Ney probabilities come out of joins between the orders. For
scoring, a language's model is a set of sorted arrays of 64-bit n-gram hashes with their log probabilities and back-off
weights, looked up by binary search. Its size is checked before it is broadcast: languages are scored in batches whose
models fit ``model_bytes`` together, and a language whose model alone is larger is scored by joining its documents'
n-grams with the probability table.

A document's log perplexity is in nats per word. How far it strays from the language's median is measured in units of
sqrt(1 / n_words + 1 / ``steady``), as short texts stray further by chance alone. The band of a language is the
quartiles of that deviation over all its documents with words, widened on both sides by ``width`` times their distance
(at least ``least``); a document outside is rejected.

Defined cases: a NULL text has no words; a NULL lang is a language of its own; a document without words is rejected by
the base rules and has no perplexity; ties do not occur; repeated rows count and are scored each; an empty table gives
no rows; other columns are ignored by ``rate`` and kept by ``keep``. A text of more than 16,384 different code points is
worked in pieces, with the same counts and scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import WORD_RE, cut, slices, text_column, trimmed

ORDER = 4
START = 0x110000  # stands for the code points before a text
GRAM = ["c1", "c2", "c3", "c4"]
FULL = 1 << 15  # symbols of an alphabet
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def codes(text: str) -> np.ndarray:
    """Code points of the words joined by single spaces."""
    return np.frombuffer(" ".join(WORD_RE.findall(text)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def runs(points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The code points with the ones before them. A text with more different ones than half an alphabet holds comes in
    pieces that have fewer; each piece knows the last code points of the one before."""
    start = np.full(ORDER - 1, START, dtype=np.int64)
    if len(points) <= FULL // 2 or len(np.unique(points)) <= FULL // 2:
        yield points, start
        return
    for at in range(0, len(points), FULL // 2):
        yield points[at : at + FULL // 2], np.concatenate([start, points[:at]])[-(ORDER - 1) :]


class Alphabet:
    """Code points <-> small numbers, so that four of them fit one 64-bit key. 0 is START."""

    def __init__(self):
        self.number = np.full(START + 1, -1, dtype=np.int64)
        self.point = np.array([START], dtype=np.int64)
        self.number[START] = 0

    def keys(self, points: np.ndarray, before: np.ndarray) -> np.ndarray | None:
        """One key per code point of a run: it and the three before it. None if the alphabet is full; a new one has room."""
        whole = np.concatenate([before, points])
        new = np.unique(whole[self.number[whole] < 0])
        if len(self.point) + len(new) > FULL:
            return None
        self.number[new] = len(self.point) + np.arange(len(new))
        self.point = np.concatenate([self.point, new])
        x = self.number[whole]
        return x[:-3] << 45 | x[1:-2] << 30 | x[2:-1] << 15 | x[3:]

    def points(self, keys: np.ndarray) -> list[np.ndarray]:
        return [self.point[keys >> shift & 0x7FFF] for shift in (45, 30, 15, 0)]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    all_keys, all_counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_counts = all_keys[order], all_counts[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]]))
    return all_keys[first], np.add.reduceat(all_counts, first)


def _count(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """n-grams of a task's documents, combined by language; sent on when more than ``most`` are held."""
    alphabet, held, size = Alphabet(), {}, 0

    def send():
        for lang, (keys, counts) in held.items():
            keys, counts = _summed(keys, counts)
            for at in range(0, len(keys), 1 << 16):
                part = slice(at, at + (1 << 16))
                columns = [pa.array(p.astype(np.int32)) for p in alphabet.points(keys[part])]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(columns[0]), pa.string()), *columns, pa.array(counts[part])], names=["lang", *GRAM, "n"])

    for batch in slices(batches, 256):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for points, before in runs(codes(text)):
                keys = alphabet.keys(points, before)
                if keys is None:
                    yield from send()
                    alphabet, held, size = Alphabet(), {}, 0
                    keys = alphabet.keys(points, before)
                if not len(keys):
                    continue
                keys, counts = np.unique(keys, return_counts=True)
                own = held.setdefault(lang, ([], []))
                own[0].append(keys)
                own[1].append(counts)
                size += len(keys)
        if size > most:
            held = {lang: tuple([x] for x in _summed(*own)) for lang, own in held.items()}
            size = sum(len(own[0][0]) for own in held.values())
            if size > most // 2:
                yield from send()
                held, size = {}, 0
    yield from send()


def train(docs: DataFrame) -> DataFrame:
    """The probability table: lang, order, c1..c4 (NULL before the n-gram's first), logp and, for n-grams that are
    contexts, logw, the weight of the next lower order."""
    lang = docs["lang"].cast("string").alias("lang")
    raw = docs.select(lang, text_column(docs).alias("text")).mapInArrow(trimmed(_count), "lang string, c1 int, c2 int, c3 int, c4 int, n long")
    grams = {ORDER: cut(raw.groupBy("lang", *GRAM).agg(F.sum("n").alias("n")), "grams-4")}
    for order in range(ORDER - 1, 0, -1):  # below the highest order an n-gram counts the different ones it ends
        grams[order] = cut(grams[order + 1].groupBy("lang", *GRAM[ORDER - order :]).agg(F.count("*").alias("n")), f"grams-{order}")

    same = lambda a, b, on: [a[c].eqNullSafe(b[c]) for c in on]
    table, lower = None, None
    for order in range(1, ORDER + 1):
        own, columns = grams[order], GRAM[ORDER - order :]
        t = [F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]
        d = own.groupBy("lang").agg(*(x.alias(f"t{i}") for i, x in enumerate(t, 1)))
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        # The three discounts of modified Kneser-Ney; counts of counts that are zero fall back to half a count.
        step = lambda i: F.when((F.col("t1") > 0) & (F.col(f"t{i}") > 0), F.greatest(F.lit(0.0), F.least(F.lit(float(i)), i - (i + 1) * y * F.col(f"t{i + 1}") / F.col(f"t{i}")))).otherwise(F.lit(0.5))
        d = cut(d.select("lang", *(step(i).alias(f"d{i}") for i in (1, 2, 3))), "discounts")
        priced = own.join(d, same(own, d, ["lang"])).drop(d["lang"])
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        priced = priced.withColumn("off", off).drop("d1", "d2", "d3")
        context = ["lang", *columns[:-1]]
        mass = cut(priced.groupBy(*context).agg(F.sum("n").alias("total"), F.sum("off").alias("spare"), F.count("*").alias("kinds")), f"contexts-{order}")
        whole = priced.join(mass, same(priced, mass, context)).select(priced["lang"], *(priced[c] for c in columns), "n", "off", "total", "spare", "kinds")
        if lower is None:  # below the unigrams: uniform over the symbols and one unseen
            whole = whole.withColumn("below", 1.0 / (F.col("kinds") + 1))
        else:
            on = ["lang", *columns[1:]]
            whole = whole.join(lower, same(whole, lower, on)).select(whole["lang"], *(whole[c] for c in columns), "n", "off", "total", "spare", lower["p"].alias("below"))
        p = (F.col("n") - F.col("off") + F.col("spare") * F.col("below")) / F.col("total")
        lower = cut(whole.select("lang", *columns, p.alias("p")), f"p-{order}")
        pad = [F.lit(None).cast("int").alias(c) for c in GRAM[: ORDER - order]]
        rows = lower.select("lang", F.lit(order).alias("order"), F.lit(False).alias("context"), *pad, *columns, F.log("p").alias("value"))
        # A context of k symbols carries the weight of order k; it is stored as a row of its own.
        at = [F.lit(None).cast("int").alias(c) for c in GRAM[: ORDER - order + 1]]
        weight = F.log(F.col("spare") / F.col("total"))
        weights = mass.select("lang", F.lit(order - 1).alias("order"), F.lit(True).alias("context"), *at, *(F.col(c).alias(t) for c, t in zip(columns[:-1], columns[1:], strict=True)), weight.alias("value"))
        table = rows.union(weights) if table is None else table.union(rows).union(weights)
    return cut(table, "model")


def hashed(points: list[np.ndarray]) -> np.ndarray:
    """64-bit hashes of n-grams given as columns of code points."""
    h = np.full(len(points[0]), 0x9E3779B97F4A7C15, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in points:
            h = (h ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
    return h


class Model:
    """One language's sorted hash arrays."""

    def __init__(self, orders: np.ndarray, contexts: np.ndarray, points: list[np.ndarray], values: np.ndarray):
        self.parts, self.unseen = {}, 0.0
        for context in (False, True):
            for order in range(ORDER + 1):
                rows = np.flatnonzero((orders == order) & (contexts == context))
                if context and order == 0:
                    self.unseen = float(values[rows[0]]) if len(rows) else 0.0
                    continue
                h = hashed([p[rows] for p in points[ORDER - order :]]) if order else np.empty(0, np.uint64)
                place = np.argsort(h)
                self.parts[context, order] = h[place], values[rows][place].astype(np.float32)
        self.unseen -= float(np.log(len(self.parts[False, 1][0]) + 1))

    def _find(self, context: bool, points: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.parts[context, len(points)]
        h = hashed(points)
        at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        hit = keys[at] == h if len(keys) else np.zeros(len(h), dtype=bool)
        return hit, values[at] if len(values) else np.zeros(len(h), np.float32)

    def logp(self, points: list[np.ndarray]) -> np.ndarray:
        """Log probability of each 4-gram's last symbol; an unseen n-gram backs off."""
        out = np.zeros(len(points[0]))
        left = np.arange(len(out))
        for order in range(ORDER, 0, -1):
            own = [p[left] for p in points[ORDER - order :]]
            hit, value = self._find(False, own)
            out[left[hit]] += value[hit]
            left, own = left[~hit], [p[~hit] for p in own]
            if not len(left):
                return out
            if order > 1:
                known, weight = self._find(True, own[:-1])
                out[left[known]] += weight[known]
        out[left] += self.unseen
        return out


def duplicate_words(words: list[str], width: int = 5) -> int:
    """Words in windows of ``width`` words that the text holds twice or more."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.zeros(n, dtype=np.uint64)
        for i in range(width):
            key = (key ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(32)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = WORD_RE.findall(text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            again += line in seen
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), again, duplicate_words(words)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _collect(table: DataFrame, langs: list[str | None]) -> dict[str | None, Model]:
    """The models of a batch of languages, whose size was checked."""
    rows = table.filter(F.col("lang").isin([x for x in langs if x is not None]) | (F.col("lang").isNull() if None in langs else F.lit(False))).toArrow()
    codes_of = rows["lang"].combine_chunks().dictionary_encode() if rows.num_rows else None
    out = {}
    for lang in langs:
        names = codes_of.dictionary.to_pylist()
        mask = np.array(codes_of.indices.is_null()) if lang is None else np.array(codes_of.indices.fill_null(-1)) == names.index(lang)
        part = rows.filter(pa.array(mask))
        points = [part[c].fill_null(0).to_numpy() for c in GRAM]
        out[lang] = Model(part["order"].to_numpy(), part["context"].to_numpy(), points, part["value"].to_numpy())
    return out


def rate(docs: DataFrame, *, width: float = 3.0, least: float = 6.0, steady: int = 400, model_bytes: int = 256 << 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the measures, base_failed, log_perplexity (nats per word), deviation, low, high (its language's band), kept, and the columns to keep."""
    spark = docs.sparkSession
    table = train(docs)
    sizes = [(r["lang"], r["n"] * 12) for r in table.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()]
    batches, wide, room = [], [], 0
    for lang, size in sizes:
        if size > model_bytes:
            wide.append(lang)
        elif not batches or room + size > model_bytes:
            batches.append([lang])
            room = size
        else:
            batches[-1].append(lang)
            room += size

    names = ["__lang", "__text", "doc_id", *keep]
    chosen = docs.select(docs["lang"].cast("string").alias("__lang"), text_column(docs).alias("__text"), "doc_id", *(docs[c] for c in keep))
    among = lambda langs: F.col("__lang").isin([x for x in langs if x is not None]) | (F.col("__lang").isNull() if None in langs else F.lit(False))
    extra = [*names[2:], "lang", "row", *MEASURES, "n_points", "logp"]
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    schema = chosen.select(*names[2:], none("lang", "string"), none("row", "long"), *(none(m, "long") for m in MEASURES), none("n_points", "long"), none("logp", "double")).schema

    def scorer(models):
        def run(batches):
            alphabet = Alphabet()
            for batch in slices(batches, 256):
                rows = []
                for lang, text in zip(batch.column("__lang").to_pylist(), batch.column("__text").to_pylist(), strict=True):
                    n_points, logp = 0, None
                    for points, before in runs(codes(text)):
                        n_points += len(points)
                        if models is None or not len(points):
                            continue
                        keys = alphabet.keys(points, before)
                        if keys is None:
                            alphabet = Alphabet()
                            keys = alphabet.keys(points, before)
                        unique, counts = np.unique(keys, return_counts=True)
                        logp = (logp or 0.0) + float(models.value[lang].logp(alphabet.points(unique)) @ counts)
                    rows.append((*measure(text), n_points, logp))
                columns = [pa.array(c, pa.float64() if i == 6 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*batch.columns[2 : len(names)], batch.column("__lang"), batch.column("__row"), *columns], names=extra)

        return trimmed(run)

    numbered = chosen.withColumn("__row", F.monotonically_increasing_id())
    parts = [numbered.filter(among(b)).mapInArrow(scorer(spark.sparkContext.broadcast(_collect(table, b))), schema) for b in batches]
    rest = numbered.filter(~among([x for b in batches for x in b])) if batches else numbered
    if wide:  # read twice and joined by row number, so the numbers are written once
        rest = cut(rest, "quality-rest")
    parts.append(_joined(rest.mapInArrow(scorer(None), schema), rest, table) if wide else rest.mapInArrow(scorer(None), schema))
    scored = parts[0]
    for part in parts[1:]:
        scored = scored.unionByName(part)
    rated = cut(scored.withColumn("log_perplexity", F.when(F.col("n_words") > 0, -F.col("logp") / F.col("n_words"))).drop("row", "n_points", "logp"), "quality")

    middle = _quantiles(rated, F.col("log_perplexity"), {"middle": 0.5}, 1000)
    spread = F.when(F.col("n_words") > 0, F.sqrt(1 / F.col("n_words") + 1 / F.lit(steady)))
    away = rated.join(middle, rated["lang"].eqNullSafe(middle["lang"]), "left").drop(middle["lang"])
    away = away.withColumn("deviation", (F.col("log_perplexity") - F.col("middle")) / spread).drop("middle")
    ends = _quantiles(away, F.col("deviation"), {"q1": 0.25, "q3": 0.75}, 100)
    room = F.greatest(width * (F.col("q3") - F.col("q1")), F.lit(least))
    bands = ends.select("lang", (F.col("q1") - room).alias("low"), (F.col("q3") + room).alias("high"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.coalesce(F.col("deviation").between(F.col("low"), F.col("high")), F.lit(False))
    out = away.join(bands, away["lang"].eqNullSafe(bands["lang"]), "left").drop("lang")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & inside)


def _quantiles(rated: DataFrame, value, shares: dict[str, float], grain: int) -> DataFrame:
    """lang and quantiles of a value over all its documents, exact to 1 / ``grain``: they come from counts."""
    at = F.floor(value * grain)
    counts = rated.filter(at.isNotNull()).groupBy("lang", at.alias("at")).agg(F.count("*").alias("n"))
    to = Window.partitionBy("lang").orderBy("at")
    run = counts.withColumn("upto", F.sum("n").over(to)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    found = run.groupBy("lang").agg(*(F.min(F.when(F.col("upto") >= s * F.col("all"), (F.col("at") + 0.5) / grain)).alias(n) for n, s in shares.items()))
    return cut(found, "quantiles")


def _joined(measured: DataFrame, rest: DataFrame, table: DataFrame) -> DataFrame:
    """Scores of documents whose model is too large to broadcast: their n-grams meet the table in a join."""

    def grams(batches):
        alphabet = Alphabet()
        for batch in slices(batches, 64):
            for row, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for points, before in runs(codes(text)):
                    keys = alphabet.keys(points, before)
                    if keys is None:
                        alphabet = Alphabet()
                        keys = alphabet.keys(points, before)
                    keys, counts = np.unique(keys, return_counts=True)
                    columns = [pa.array(p.astype(np.int32)) for p in alphabet.points(keys)]
                    full = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([row] * full, pa.int64()), pa.array([lang] * full, pa.string()), *columns, pa.array(counts)], names=["row", "lang", *GRAM, "times"])

    own = rest.select("__row", "__lang", "__text").mapInArrow(grams, "row long, lang string, c1 int, c2 int, c3 int, c4 int, times long")
    top = table.filter((F.col("order") == ORDER) & ~F.col("context"))
    met = own.join(top, [own["lang"].eqNullSafe(top["lang"]), *(own[c] == top[c] for c in GRAM)])
    sums = met.groupBy("row").agg(F.sum(F.col("value").cast("float").cast("double") * F.col("times")).alias("total"))
    out = measured.join(sums, "row", "left")
    return out.withColumn("logp", F.col("total")).drop("total").select(*measured.columns)


def keep(docs: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, unchanged."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    renamed = {c: f"__doc_{c}" for c in others}
    inside = docs.select("doc_id", docs["lang"], docs["text"], *(docs[c].alias(renamed[c]) for c in others))
    rated = rate(inside, keep=tuple(renamed.values()), **options).filter("kept")
    return rated.select(*(F.col(renamed[c]).alias(c) if c in renamed else F.col(c) for c in docs.columns))
