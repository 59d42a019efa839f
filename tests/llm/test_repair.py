import hashlib
import itertools
import random
import re
import zlib

from plumbline.llm import repair
from plumbline.llm.queries import op12_audit_repair

GOOD = re.compile(r"(s?(ua)+)?\Z")


def every_edit(rows):
    """The cheapest edits of (initial, must go, truncated) by trying all, with up to two inserts in a gap."""
    gaps = [""] + ["".join(p) for n in (1, 2) for p in itertools.product("ua", repeat=n)]
    best = None
    ways = []
    for initial, must_go, truncated in rows:
        ways.append([("D", "", 3)] if must_go else [("K", initial, truncated), ("R", "u", 2 + truncated), ("R", "a", 2 + truncated), ("D", "", 3)])
    for picks in itertools.product(*ways):
        for holes in itertools.product(gaps, repeat=len(rows) + 1):
            said = holes[0] + "".join(p[1] + h for p, h in zip(picks, holes[1:]))
            if GOOD.match(said):
                audit = "I" * len(holes[0]) + "".join(p[0] + "I" * len(h) for p, h in zip(picks, holes[1:]))
                found = (sum(p[2] for p in picks) + 2 * sum(map(len, holes)), audit)
                best = found if best is None or found < best else best
    return best


def plain(rows):
    """The same by a table of whole strings."""
    def insert(table):
        for s in (0, 1, 3, 2):
            if s in table:
                cost, audit = table[s]
                to = repair.WANTED[s][1]
                table[to] = min(table.get(to, (1e9, "")), (cost + 2, audit + "I"))
        return table

    table = insert({0: (0, "")})
    for initial, must_go, truncated in rows:
        new = {}
        for s, (cost, audit) in table.items():
            found = [(s, cost + 3, "D")]
            if not must_go:
                found.append((repair.WANTED[s][1], cost + 2 + truncated, "R"))
                if not initial or (s, initial) in repair.STEPS:
                    found.append((repair.STEPS[s, initial] if initial else s, cost + truncated, "K"))
            for to, c, e in found:
                new[to] = min(new.get(to, (1e9, "")), (c, audit + e))
        table = insert(new)
    return min(table[s] for s in (0, 3) if s in table)


def solve(rows):
    r = repair.Repair()
    for row in rows:
        r.row(*row)
    return r.end()


def some(rng, n, alphabet="uuuaaasx"):
    return [(rng.choice(alphabet), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_equals_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = some(rng, rng.randint(0, 3), ["u", "a", "s", "x", ""])
        assert solve(rows) == every_edit(rows), rows


def test_long_conversations_and_settling():
    rng = random.Random(2)
    for n in (50, 500, 6000):
        for alphabet in ("uuuaaasx", "u", "a", "s", "ua"):
            rows = some(rng, n, alphabet)
            assert solve(rows) == plain(rows)
    r = repair.Repair()
    for _ in range(30_000):
        r.row("u", False, False)
        r.row("a", False, False)
    assert r.end() == (0, "K" * 60_000) and len(r.nodes.parent) < 10_000


def test_colliding_hashes_are_found(monkeypatch):
    monkeypatch.setattr(repair.Prefixes, "MOD", 3)
    rng = random.Random(3)
    for _ in range(60):
        rows = some(rng, rng.randint(1, 60))
        assert solve(rows) == plain(rows)


def test_prefix_order():
    p, rng = repair.Prefixes(), random.Random(4)
    nodes = [0]
    for _ in range(400):
        nodes.append(p.add(rng.choice(nodes[-6:]), rng.choice(b"DIKR")))
    for _ in range(2000):
        x, y = rng.choice(nodes), rng.choice(nodes)
        assert p.text(p.least(x, y)) == min(p.text(x), p.text(y))


def expected(rows):
    """The contract, row by row in Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            how = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if how:
                text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
                after += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in after:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in after if t is not None}
        cost, audit = plain([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(after, faults)])
        said, state, left = [], 0, iter(after)
        for e in audit:
            role, text = ("", "") if e == "I" else next(left)[1:]
            if e == "D":
                continue
            if e in "IR":
                role, state = repair.WANTED[state]
            elif role:
                state = repair.STEPS[state, role[0]]
            said.append(f"{role}:{text}")
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:])), cost, audit,
            hashlib.sha256("\n".join(said).encode()).hexdigest(),
        )
    return out


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_equals_plain_python(spark):
    rng = random.Random(8)
    texts = ["Good.", "Cut off", "Why? ", " \n", "", None, "Zwölf!\x0b", "a:b\nc.", "x" * 20_000 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", None, "", "tool"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {c} {t}.") for c in [None, *range(60)] for t in range(rng.randint(1, 14))]
    rows += [(c, None, "system", "First.") for c in range(10)] + [(3, 70, "user", "Far."), (4, 2, "user", "Same turn."), (4, 2, "user", "Another.")]
    rows += rows[:5] + [(100, t, ("user", "assistant")[t % 2], f"Long {t}.") for t in range(3000)]  # repeated rows, a long one
    made = [(*r, "x", 1, "y") for r in rows]
    rng.shuffle(made)
    df = spark.createDataFrame(made, "conv_id long, turn long, role string, text string, audit string, cost int, digest string").repartition(3)
    got = repair.repair_damaged(df).collect()
    assert len(got) == len({r[0] for r in rows})
    assert {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got} == expected(rows)


def test_registered_query_equals_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = op12_audit_repair(spark, sf).collect()
    assert {r["conv_id"]: tuple(r[c] for c in NAMES) for r in got} == expected(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repair_damaged(df).collect() == []


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "tool", "Well.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.audits(df)
    assert found.first()["audit"] == "IKKR"
    got = [(r["edit"], r["role"], r["text"]) for r in sorted(repair.repaired(df, found).collect(), key=lambda r: r["place"])]
    assert got == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Hi."), ("R", "assistant", "Well.")]
