"""Archives, hard negatives and conversation repair against brute force on small tables of hard cases."""

import hashlib
import heapq
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veta.llm import conversation_repair as cr
from veta.llm import hard_negatives as hn
from veta.llm import warc

# ---- archives ---------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string, text string, type string, digest string, file string"


def pages():
    rng = random.Random(3)
    long = "".join(rng.choice("abc é🙂\r\n\r\n<>") for _ in range(300_000))
    shared, odd = "<p>shared</p>" * 20, "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9
    rows = [(i, f"http://x/{i}?a b\r\nX: é", shared) for i in range(60, 20, -1)]
    rows += [(i, None, f"<p>{i}</p>" * 30) for i in range(5)] + [(7, "u", long), (6, "u", long), (8, "", odd), (9, "u", odd)]
    rows += [(10, "u", "x" * 99), (11, "u", "x" * 99), (12, "u", "é" * 50), (13, "u", "é" * 50), (14, "u", None), (15, "u", ""), (None, "u", shared), (None, "u", "n" * 200), (None, "u", "n" * 200)]
    rows += [(16, "u", "r" * 100), (16, "u", "r" * 100), (-5, "u", odd)]
    return [(*r, "t", "revisit", "d", "f") for r in rows]


def expected_pages(rows, least=100):
    payloads = [(r[0], (r[2] or "").encode()) for r in rows]
    out, first = Counter(), {}
    for i, p in sorted(payloads, key=lambda x: (x[0] is None, x[0])):
        told = len(p) >= least and p in first
        out[i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if told else "response", first[p] if told else None] += 1
        first.setdefault(p, i)
    return out


def listed(frame):
    return Counter(tuple(r) for r in frame.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


def test_archives(spark, monkeypatch):
    frame = spark.createDataFrame(pages(), PAGES).repartition(3)
    crawled = warc.write_archives(frame, section=1000, most=3000)
    assert crawled.agg(F.sum("records")).first()[0] == len(pages())
    assert crawled.select("file").distinct().count() > 3
    assert listed(warc.resolved(crawled)) == expected_pages(pages(), 10**9)
    kept = warc.deduplicate(crawled)
    assert listed(warc.resolved(kept)) == expected_pages(pages())
    # deduplicated archives stay as they are; heavy digests go by the other join
    monkeypatch.setattr(warc, "HEAVY_LEAST", 2)
    assert listed(warc.resolved(warc.deduplicate(kept))) == expected_pages(pages())
    none = spark.createDataFrame([], PAGES)
    assert warc.resolved(warc.deduplicate(warc.write_archives(none))).count() == 0


def test_records_are_warc(spark):
    import gzip

    crawled = warc.deduplicate(warc.write_archives(spark.createDataFrame(pages(), PAGES)))
    sizes = Counter()
    for file in {r["file"] for r in crawled.collect()}:
        with open(re.sub("^file:/+", "/", file), "rb") as f:
            data = gzip.decompress(f.read())
        at = 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            head = dict(line.split(": ", 1) for line in data[at:end].decode("ascii").split("\r\n")[1:])
            assert data[at : at + 10] == b"WARC/1.1\r\n"
            at = end + 4 + int(head["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            sizes[head["WARC-Type"]] += 1
            if head["WARC-Type"] == "revisit":
                assert head["WARC-Profile"] == warc.PROFILE and head["WARC-Refers-To"] != head["WARC-Record-ID"]
    told = Counter(k[3] for k in expected_pages(pages()).elements())
    assert sizes == told


def test_broken_records_are_refused():
    data = warc.response("urn:uuid:1", 1, "u", b"payload")
    fields, block = warc.parse(data)
    assert warc._checked(fields, block) == (hashlib.sha256(b"payload").hexdigest(), 7)
    for bad in (data[:-1], data[10:], data.replace(b"payload", b"payloa", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)
    fields, block = warc.parse(data.replace(b"payload\r\n", b"PAYLOAD\r\n"))
    with pytest.raises(ValueError):
        warc._checked(fields, block)


# ---- hard negatives ---------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, id int, chunk int, score double"


def vectors(size=60, scale=1.0, dim=70):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, dim))
    rows = []
    for i in range(size):
        v = np.float32(scale * (centres[i % 3] * 0.3 + rng.normal(size=dim) * 0.2)).tolist()
        rows.append([i * 10, v, int(rng.integers(0, 4))])
    rows[3][1], rows[10][1] = rows[2][1], rows[20][1]  # ties
    rows += [rows[0], rows[10], rows[5], [None, rows[7][1], 1], [None, rows[0][1], 2]]
    rows += [[1000, None, 1], [1100, [math.nan] * dim, 1], [1200, [math.inf] * dim, 1], [1300, [None] * dim, 1], [1400, rows[1][1], None], [1500, [], 1], [1600, rows[4][1][:5], 2]]
    return [(*r, "k", 1, 1, 1.0) for r in rows]


def expected_negatives(rows):
    part = []
    for n, (i, v, label, *_) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        part.append((n, i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    rank = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = Counter()
    for n, i, label, v in part:
        if i is None or i % 100:
            continue
        scored = [(j, sum(a * b for a, b in zip(v, w)), other, m) for m, j, other, w in part]
        for j, top, _, _ in sorted((s for s in scored if s[2] == label and s[3] != n), key=rank)[:5]:
            near = sorted((s for s in scored if s[2] != label and 80 * top <= 100 * s[1] <= 100 * top), key=rank)[:5]
            for place, (k, score, _, _) in enumerate(near, 1):
                out[i, j, place, k, top, score] += 1
    return out


@pytest.mark.parametrize("scale", [1.0, 1000.0, 3e33])
def test_hard_negatives(spark, monkeypatch, scale):
    monkeypatch.setattr(hn, "CHUNK_ROWS", 16)
    rows = vectors(scale=scale)
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = Counter()
    for (i, j, place, k, top, score), c in expected_negatives(rows).items():
        want[i, j, place, k, clip(top), clip(score)] += c
    found = hn.mine(spark.createDataFrame(rows, VECTORS).repartition(3))
    got = Counter(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == want and len(got) > 20


def test_hard_negatives_of_nothing(spark):
    assert hn.mine(spark.createDataFrame([], VECTORS)).count() == 0
    assert hn.mine(spark.createDataFrame([(0, [], 1, "", 1, 1, 1.0), (5, [], 1, "", 1, 1, 1.0), (6, [], 2, "", 1, 1, 1.0)], VECTORS)).collect() == [(0, 6, 1, 5, 0, 0)]  # the label of 0 moves to 2


@pytest.mark.parametrize("size", [1, 40, 300, 10**6, 10**30])
def test_residue_products_are_exact(size):
    rng = random.Random(size)
    a, b = ([[float(rng.randint(-size, size)) for _ in range(150)] for _ in range(6)] for _ in range(2))
    whole = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    primes = hn.primes_for(max(abs(x) for row in whole for x in row))
    assert len(set(primes)) == len(primes) and all(p % q for p in primes for q in range(2, math.isqrt(p) + 1))
    got = hn.remainder_scores(hn.products(hn.residues(np.array(a), primes), hn.residues(np.array(b), primes), primes), primes)
    assert got.tolist() == whole


# ---- conversations ----------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """All edits by Dijkstra's search over (turn, what was said last), audits in ASCII order."""
    heap, done = [(0, "", 0, "")], set()
    best = None
    while heap:
        cost, audit, i, said = heapq.heappop(heap)
        if best is not None and cost > best[0]:
            return best
        if i == len(turns) and said in ("", "a"):
            best = min(best, (cost, audit)) if best else (cost, audit)
            continue
        if (cost, audit, i, said) in done:
            continue
        done.add((cost, audit, i, said))
        letter = "a" if said == "u" else "u"
        heapq.heappush(heap, (cost + 2, audit + "I", i, letter))
        if i < len(turns):
            stay = turns.stays(i)
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, said))
            if stay < cr.FAR:
                c = turns.initials[i]
                if c == letter or (c == "s" and not said):
                    heapq.heappush(heap, (cost + stay, audit + "K", i + 1, c))
                if c != letter:
                    heapq.heappush(heap, (cost + stay + 2, audit + "R", i + 1, letter))
    return best


def test_alignment_is_cheapest_and_least():
    rng = random.Random(11)
    cases = [("".join(c), bytes(n)) for n in range(5) for c in itertools.product("suat", repeat=n)]
    cases += [("".join(rng.choice("suaat\0") for _ in range(n)), bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))) for n in range(9) for _ in range(40)]
    for initials, faults in cases:
        turns = cr.Turns(initials, faults)
        want = cheapest(turns)
        assert cr.greedy_cost(turns) >= want[0]
        assert cr.repair(turns) == want, (initials, faults)
        assert cr.repair(turns, 0) == want, (initials, faults)


def test_band_and_folded_tables_agree_on_long_conversations():
    rng = random.Random(2)
    for n in (50, 301, 900):
        for noise in (0.02, 0.3, 1.0):
            initials = "".join(rng.choice("suat") if rng.random() < noise else "ua"[i % 2] for i in range(n))
            faults = bytes(rng.choice([0, 1, 2, 3]) if rng.random() < noise else 0 for _ in range(n))
            turns = cr.Turns(initials, faults)
            assert cr.repair(turns) == cr.repair(turns, 0)


TURNS = "conv_id bigint, turn bigint, role string, text string, kept int, initial string, digest string, part int, audit string, cost int"


def conversations():
    rng = random.Random(9)
    texts = ["Hello there.", "And so on", "Why? ", " \t", "", None, "end!\n", "é", "Hello there."]
    rows = []
    for c in range(60):
        for t in range(rng.randint(0, 14)):
            role = "system" if not t and rng.random() < 0.4 else rng.choice(["user", "assistant"]) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            rows.append((c, t, rng.choice([role] * 9 + [None, "tool", "", "system"]), rng.choice([*texts, f"a {c} {t}.", f"b {c} {t}"])))
    rows += [(None, t, "user", f"x{t}.") for t in range(6)] + [(70, None, "user", "a."), (70, None, "assistant", None), (70, 5, "assistant", "b." * 3000)]
    rows += [(71, -(2**63), "user", "a."), (71, 2**63 - 1, "user", "b.")] + [(72, 1, "user", "twice.")] * 2
    rows += [(100 + c, 0, "user", "only.") for c in range(60)]  # some lose every row
    return [(*r, 1, "i", "d", 2, "a", 3) for r in rows]


def expected_repairs(rows):
    groups = {}
    for c, t, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        groups.setdefault(c, []).extend([(t, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    out = {}
    for c, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        faults, seen = bytearray(), set()
        for _, role, text in turns:
            body = text.strip(WHITE)
            faults.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
            seen.add((role, text))
        cost, audit = cheapest(cr.Turns("".join(r[1][:1] or "\0" for r in turns), bytes(faults)))
        said, i = [], 0
        for e in audit:
            letter = "user" if (len(said) - (bool(said) and said[0][0] == "s")) % 2 == 0 else "assistant"
            if e == "I":
                said.append(f"{letter}:")
                continue
            if e != "D":
                said.append(f"{turns[i][1] if e == 'K' else letter}:{turns[i][2]}")
            i += 1
        known = {r[0] for r in turns if r[0] is not None}
        gaps = (max(known) - min(known) + 1 - len(known) + 2**63) % 2**64 - 2**63 if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_conversations(spark):
    rows = conversations()
    got = cr.repaired(spark.createDataFrame(rows, TURNS).repartition(5)).collect()
    want = expected_repairs(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r
    assert sum(not r["audit"] for r in got) > 0
    assert cr.repaired(spark.createDataFrame([], TURNS)).count() == 0
