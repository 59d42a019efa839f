"""Secret scans with multipart credential linking.

Strong patterns report by themselves. Weak parts - short-lived access identifiers, bare 40-character secrets, service
endpoints - are common in clean text, so one is reported only where complementary parts are near: the parts of a text
are intervals, a scope is a paragraph (text between blank lines) cut to ``reach`` code points around a part, and an
interval join of parts with scopes finds what co-occurs. It is a sweep over sorted intervals inside each document, so
nothing is shuffled and no pairs are made.

Defined cases: a NULL text is empty and has no spans; ties of start follow the order of ``KINDS``; repeated rows are
scanned each; other columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import slices, text_column, trimmed

# The strong patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# The weak parts.
WEAK_ID = re.compile(r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{16}(?![A-Z0-9])")
# An '=' before the characters assigns them; after them it is padding, unless more follows and they are a name themselves.
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}={0,2}(?![A-Za-z0-9+/=])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]+(?::\d+)?|(?<![A-Za-z0-9.-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com")
BREAK = re.compile(r"\n[ \t\r]*\n")

KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def strong(text: str) -> list[tuple[str, int, int]]:
    low, found = text.lower(), []
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _near(part: tuple[int, int], others: list[tuple[int, int]], breaks: list[int], reach: int) -> bool:
    """Whether one of the sorted, disjoint intervals lies inside the scope of the part."""
    at = bisect_right(breaks, part[0])
    low = max(part[0] - reach, breaks[at - 1] if at else 0)
    high = min(part[1] + reach, breaks[at] if at < len(breaks) else part[1] + reach)
    i = bisect_left(others, (low, -1))
    while i < len(others) and others[i][0] < high:
        if others[i][1] <= high and others[i] != part:
            return True
        i += 1
    return False


def scan_text(text: str, reach: int = 200) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind."""
    found = strong(text)
    weak_ids = [m.span() for m in WEAK_ID.finditer(text)]
    ids = sorted([s[1:] for s in found if s[0] == "access"] + weak_ids)
    sure = [s[1:] for s in found if s[0] != "access"]
    if ids or sure:
        spans = sorted(sure)
        inside = lambda s: (i := bisect_right(spans, (s[0], 1 << 62))) > 0 and spans[i - 1][1] >= s[1]
        weak_secrets = [m.span() for m in WEAK_SECRET.finditer(text) if not inside(m.span())] if ids else []
        secrets = sorted(spans + weak_secrets)
        breaks = [m.start() for m in BREAK.finditer(text)]
        found += [("linked_id", *s) for s in weak_ids if _near(s, secrets, breaks, reach)]
        found += [("linked_secret", *s) for s in weak_secrets if _near(s, ids, breaks, reach)]
        if ids and secrets:
            ends = [m.span() for m in ENDPOINT.finditer(text)]
            found += [("linked_endpoint", *s) for s in ends if _near(s, ids, breaks, reach) and _near(s, secrets, breaks, reach)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each run of overlapping spans becomes one mark that names its first kind."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, *, reach: int = 200) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of each row."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in slices(batches):
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, reach)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, to_arrow_type(SPAN))], names=["doc_id", "spans"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("spans", SPAN)])
    return docs.select("doc_id", text_column(docs).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, *, reach: int = 200) -> DataFrame:
    """The documents with every secret replaced by a mark; n_chars, where there is one, follows."""

    def cleaned(texts):
        for batch in texts:
            parts = (batch.slice(at, 512).to_pylist() for at in range(0, len(batch), 512))  # few texts are Python objects at a time
            done = [pa.array([None if t is None else redact_text(t, scan_text(t, reach)) for t in part], pa.string()) for part in parts]
            yield pa.concat_arrays(done or [pa.array([], pa.string())])

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from trimmed(cleaned)(texts)

    out = docs.withColumn("text", clean(docs["text"].cast("string")))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def digest(scanned: DataFrame) -> DataFrame:
    """Counts of the strong kinds, the SHA-256 of their list, and the list of all spans."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id",
        *map(n, KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, line)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", line)).alias("spans"),
    )
