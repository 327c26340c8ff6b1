"""Operators on documents against brute force on a small table of hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from veta.llm import (
    components, fingerprints, gru, lm, mixing, packing, quality_rules, simhash_dedup, substring_dedup, suffix_dedup, token_counts, tokens, windows,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size):
    w = words(text)
    return [" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


def votes(hashes):
    if not hashes:
        return 0
    ones = [sum(h >> b & 1 for h in hashes) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))


def h64(text):
    return xxhash.xxh64_intdigest(text.encode(), seed=42)


def key(row):
    return tuple((x is None, str(x)) for x in row)


def test_simhash_near_duplicates(data, docs, none):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fps = [votes([h64(s) for s in shingles((t or "").translate(lower), 3)]) for _, t, *_ in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    want = [(r[0], f"{fps[i]:016x}", least.get(root(i))) for i, r in enumerate(data)]
    found = simhash_dedup.as_contract(simhash_dedup.near_duplicates(docs))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert simhash_dedup.near_duplicates(none).count() == 0
    kept = simhash_dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({root(i) for i in range(len(data))})
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("light", [256, 2])
def test_links_join_what_all_pairs_join(spark, monkeypatch, bits, light):
    """With a low limit every key takes the path for crowded keys."""
    monkeypatch.setattr(simhash_dedup, "LIGHT", light)
    rng = np.random.default_rng(bits)
    centre = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    fps = {c ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 4))) for c in centre for _ in range(8)} | {0, (1 << 64) - 1}
    fps = sorted(simhash_dedup.signed(f) for f in fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = {r["node"]: r["root"] for r in components.components(simhash_dedup.links(frame, bits)).collect()}
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a in fps:
        for b in fps:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= bits and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {f: got.get(f, f) for f in fps} == {f: root(f) for f in fps}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (60, 50)], "u bigint, v bigint")
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {50: 50, 60: 50}


def test_fingerprints(data, docs, none, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_CHARS", 4000)  # many ranges
    plain = docs.filter("doc_id is not null and text is distinct from 'x' and not (doc_id = 3 and n_chars = 5)").dropDuplicates(["doc_id"])
    rows = sorted(((r["doc_id"], r["text"] or "") for r in plain.collect()), reverse=True)

    def fp(text):
        first = [h64(s) for s in shingles(text, 2)]
        second = [xxhash.xxh64_intdigest((h).to_bytes(8, "little"), seed=42) for h in first]
        return f"{votes(first):016x}{votes(second):016x}"

    alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
    want = {}
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + following[:third]
        a, b, c = fp(text), fp(edited), fp(following)
        want[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, alike(a, b), alike(a, c))
    found = fingerprints.edited_fingerprints(plain)
    hexed = found.select("doc_id", "n_chars", "edited_sha256", fingerprints.hex32(F.col("fp"), F.col("fp2")), fingerprints.hex32(F.col("efp"), F.col("efp2")), "near_edited", "near_next")
    assert {r[0]: tuple(r[1:]) for r in hexed.collect()} == want
    everything = fingerprints.edited_fingerprints(docs)  # null and repeated ids
    assert everything.count() == len(data)
    assert everything.filter("near_edited is null or near_next is null").count() == 0
    assert fingerprints.edited_fingerprints(none).count() == 0
    for radius in (0, 3, 5):
        near = {(r["fp"], r["fp2"]): r["n_near"] for r in fingerprints.near_counts(found, found, radius).collect()}
        pairs = [(r["fp"], r["fp2"]) for r in found.select("fp", "fp2").collect()]
        full = (1 << 64) - 1
        distance = lambda p, q: ((p[0] ^ q[0]) & full).bit_count() + ((p[1] ^ q[1]) & full).bit_count()
        assert near == {p: sum(distance(p, q) <= radius for q in pairs) for p in pairs}


def test_quality_statistics(data, docs, none):
    want = []
    for doc, text, *_ in data:
        w = words(text)
        windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        inside = {j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        want.append((doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside),
                     len(w) < 10 or 100 * len(inside) > 20 * len(w)))
    got = quality_rules.statistics(docs).select("doc_id", *quality_rules.BASE_COLUMNS, "base_failed").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert quality_rules.statistics(none).count() == 0


def test_rules_find_the_bad_and_keep_the_rest(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        bad = i % 5 == 0
        n = int(rng.integers(20, 60))
        rows.append((i, " ".join(("w#%$" if bad and k % 3 == 0 else "w") + str(int(rng.integers(0, 9999))) for k in range(n)), int(not bad)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    labels = frame.select("doc_id", "quality", F.lit(0).alias("toxic")).union(spark.createDataFrame([(None, 1, 0), (1, None, 0)], "a bigint, b int, c int"))
    judged = {r["doc_id"]: r["kept"] for r in quality_rules.judged(frame, labels).collect()}
    right = sum(judged[i] == bool(q) for i, _, q in rows)
    assert right > 0.99 * len(rows)
    assert all(judged[i] for i, _, q in rows if q)
    again = {r["doc_id"] for r in quality_rules.keep_good(frame, labels).collect()}
    assert again == {i for i, k in judged.items() if k}
    without = quality_rules.judged(frame, labels.limit(0))
    assert without.filter("kept").count() == len(rows)


def test_encoder_is_the_tokenizer(data):
    encode = tokens.encoder(tokens.tokenizer_path())
    texts = [t for _, t, *_ in data if t] + ["a  b", " a b ", " \n x", "it 's '  s", "a\x1c b", "a \x1cb", "  x 　 y", "1 2  3 .. ,a"]
    texts += ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "<|endoftext|", "x <|endoftext|>\n y"]
    fresh = Tokenizer.from_file(tokens.tokenizer_path())
    for text in texts:
        want = fresh.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.encode(text), "<u4").tolist() == want


def test_token_counts(data, docs, none, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 16)
    encode = tokens.encoder(tokens.tokenizer_path()).encode
    lengths = [len(encode(t)) // 4 for _, t, *_ in data]
    sums = token_counts.suffix_sums(token_counts.length_histogram(docs)).cache()
    for r in sums.collect():
        n = r["length"]
        assert r["n_docs"] == lengths.count(n)
        assert (r["docs_from"], r["tokens_from"]) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r["truncated_total"] == sum(min(x, n) for x in lengths)
        assert math.isclose(r["docs_upto_share"], sum(x <= n for x in lengths) / len(lengths))
    assert sums.count() == len(set(lengths))
    for limit in (0, 1, 7, 100, 10**6):
        assert token_counts.truncated_total(sums, limit) == sum(min(x, limit) for x in lengths)
    assert token_counts.length_quantile(sums, 0.5) == sorted(lengths)[math.ceil(len(lengths) / 2) - 1]
    empty = token_counts.suffix_sums(token_counts.length_histogram(none))
    assert (empty.count(), token_counts.truncated_total(empty, 5), token_counts.length_quantile(empty, 0.5)) == (0, 0, None)


def test_packing(data, docs, none, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 10)
    encode = tokens.encoder(tokens.tokenizer_path()).encode
    for sequence, unit in ((2048, 8), (64, 4)):
        got = packing.pack(docs, sequence=sequence, unit=unit).collect()
        want = []
        for doc, text, *_ in data:
            ids = encode(text) + (1).to_bytes(4, "little")
            n = len(ids) // 4
            want += [(doc, s, min(sequence, n - s), zlib.crc32(ids[4 * s : 4 * (s + sequence)]), n) for s in range(0, n, sequence)]
        assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
        sequences = {}
        for r in got:
            sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for each in sequences.values():
            at = 0
            for offset, length in sorted(each):
                assert offset == at
                at += length
            assert at <= sequence
        assert sum(w[2] for w in want) > 0.85 * sequence * len(sequences)
    assert packing.pack(none).count() == 0


def test_patterns_are_near_the_bound():
    rng = np.random.default_rng(3)
    demand = {int(s): int(n) for s, n in zip(range(1, 21), rng.integers(0, 500, 20), strict=True)}
    plan = packing.solve(demand, 64)
    packed = Counter()
    for times, pattern in plan:
        assert sum(s * n for s, n in pattern.items()) <= 64
        for s, n in pattern.items():
            packed[s] += times * n
    assert packed == Counter({s: n for s, n in demand.items() if n})
    assert sum(t for t, _ in plan) <= math.ceil(sum(s * n for s, n in demand.items()) / 64) * 1.01 + 1
    assert packing.solve({}, 64) == []


def test_mixing(data, docs, none):
    rows = mixing.taken(docs).collect()
    assert len(rows) == len(data)
    by_source = {}
    for r in rows:
        by_source.setdefault((r["source_size"], r["target"]), []).append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    sizes = Counter()
    for _, text, _, source, *_ in data:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    goal, open_ = {}, set(order)
    left = float(sum(sizes.values()))
    while True:  # reshare what is above the cap
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        open_ -= over
    goal |= {s: share * weight[s] for s in open_}
    assert sorted((sizes[s], round(goal[s], 6)) for s in order) == sorted((s, round(t, 6)) for s, t in by_source)
    for (_, target), each in by_source.items():
        assert abs(sum(r["taken"] for r in each) - target) < 60
    assert sorted(map(tuple, rows), key=key) == sorted(map(tuple, mixing.taken(docs.repartition(7)).collect()), key=key)
    mixed = mixing.mix(docs, shards=8)
    assert mixed.columns == docs.columns
    drawn = sum(r["copies"] for r in rows)
    assert mixed.count() == drawn
    assert mixing.taken(none).count() == 0 and mixing.mix(none).count() == 0


def test_mixing_rows_without_an_id_and_of_one_id(spark):
    ten, spread = "a b c d e f g h i j", "a b c d e"
    rows = [(None, "s1", ten)] * 60 + [(None, "s1", f"{ten} {i}") for i in range(40)] + [(i, "s2", ten) for i in range(100)]
    rows += [(7000, "s3", spread)] * 50 + [(8000 + i, "s3", spread) for i in range(50)]
    frame = spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)
    got = mixing.taken(frame, shards=8).collect()
    totals = Counter()
    for r in got:
        totals[r["source_size"], r["target"]] += r["taken"]
        assert r["taken"] == r["size"] * len(r["draws"]) == r["size"] * r["copies"] and all(0 <= s < 8 for s in r["draws"])
    assert len(got) == len(rows) and len(totals) == 3
    assert all(abs(target - taken) <= 12 for (_, target), taken in totals.items())
    equal = [r["copies"] for r in got if r["doc_id"] is None and r["size"] == 10]
    assert max(equal) - min(equal) <= 1 and len(equal) == 60
    assert sorted(map(str, got)) == sorted(map(str, mixing.taken(frame.repartition(3), shards=8).collect()))
    mixed = mixing.mix(frame, shards=8).groupBy("source").count().collect()
    drawn = Counter()
    for r in got:
        drawn[r["source_size"]] += r["copies"]
    assert sorted(r["count"] for r in mixed) == sorted(drawn.values())


def test_splitting_tree_keeps_quotas():
    quotas = [1000, 3, 0, 77]
    split = mixing.split_quotas(quotas, 16)
    assert split.sum(axis=0).tolist() == quotas and split.min() >= 0
    assert split.sum(axis=1).max() - split.sum(axis=1).min() <= 4


def removed(sequences, length, cut):
    counts = Counter(cut(s, i, length) for s in sequences for i in range(len(s) - length + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if counts[cut(s, i, length)] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length,gram", [(200, 64), (40, 16)])
def test_suffix_dedup(data, docs, none, monkeypatch, length, gram):
    from veta.llm import windows
    if gram == 16:
        monkeypatch.setattr(windows, "SEGMENT", 300)
    texts = [(t or "").encode() for _, t, *_ in data]
    masks = removed(texts, length, lambda s, i, n: s[i : i + n])
    want = []
    for (doc, *_), raw, gone in zip(data, texts, masks, strict=True):
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone]) if raw else b""
        want.append((doc, len(raw), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    got = suffix_dedup.duplicate_bytes(docs, length=length, gram=gram).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert suffix_dedup.duplicate_bytes(none).count() == 0
    cut = suffix_dedup.without_duplicates(docs, length=length, gram=gram)
    assert cut.columns == docs.columns and cut.count() == len(data)


def test_suffix_order_survives_hash_collisions(monkeypatch):
    monkeypatch.setattr(suffix_dedup.Suffixes, "_run", lambda self, i, n: 0)  # all hashes collide
    s = suffix_dedup.Suffixes([b"abcabd", b"abcxyz"])
    assert s.verified(0, 6, s.extension(0, 6, 6, 6)) == 3


@pytest.mark.parametrize("length,gram", [(35, 9), (8, 3)])
def test_substring_dedup(data, docs, none, length, gram):
    sequences = [words(t) for _, t, *_ in data]
    masks = removed(sequences, length, lambda s, i, n: tuple(s[i : i + n]))
    want = []
    for (doc, *_), w, gone in zip(data, sequences, masks, strict=True):
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((doc, len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring_dedup.duplicate_words(docs, length=length, gram=gram).drop("kept").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert substring_dedup.duplicate_words(none).count() == 0


def test_lm_counts_and_base_score(data, docs, none, monkeypatch):
    monkeypatch.setattr(lm, "SHIPPED", 50)
    monkeypatch.setattr(lm, "COUNTED_WORDS", 30)
    split = [zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, *_ in data]
    tokens_ = [[*words((t or "").encode().lower().decode()), None] for _, t, *_ in data]
    counts = Counter(x for held, ts in zip(split, tokens_, strict=True) if not held for x in ts)
    total, kinds = sum(counts.values()), len(counts)
    want = [
        (d, held, len(ts), sum(counts[x] > 0 for x in ts), total, round(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in ts), 6))
        for (d, *_), held, ts in zip(data, split, tokens_, strict=True)
    ]
    got = lm.scores(docs).collect()
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in got), key=key) == sorted(want, key=key)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.scores(none).count() == 0


def test_lm_words_are_cut_counted_and_numbered_in_columns(spark, monkeypatch):
    """Whatever stretch of texts is cut at a time, the words are those of a plain split; no loop runs over words."""
    texts = [" a B\x0b\x0cb ", "", "É x\x1cy\x85z\n", " \t", "one", "É\u2003a\r\nQ" * 40, "q"]
    want = [t.encode().lower().decode().encode().split() for t in texts]
    for size in (1, 60, 10**6):
        monkeypatch.setattr(lm, "CUT_BYTES", size)
        got = [x for some, words_, lengths in lm._cut(pa.array(["-", *texts])[1:]) for x in zip(some.to_pylist(), lm._closed(np.array(words_.to_pylist(), object), lengths, None), strict=True)]
        assert [t for t, _ in got] == texts
        assert [[w.encode() for w in ws[:-1]] for _, ws in got] == want and all(ws[-1] is None for _, ws in got)
    assert not [x for x in lm._cut(pa.array([], pa.string())) if len(x[0])]
    assert lm._numbered(pa.array(["b", "é", "a", "b"]), pa.array(["a", "b"])).tolist() == [1, -1, 0, 1]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    assert {r["word"].encode(): r["c"] for r in lm._counted(frame).collect()} == Counter(w for ws in want for w in ws)


def test_gru_scores_need_no_maximum_while_weights_are_small():
    """Softmaxes with and without their maximum taken off agree; weights out of bounds take it off."""
    rng = np.random.default_rng(1)
    model = gru.Model.start(rng.integers(1, 10**6, gru.WORDS).astype(float), 30.0)
    model = model.like(model.flat() + rng.standard_normal(model.flat().size))
    h, goals = np.tanh(rng.standard_normal((5000, gru.HIDDEN))).astype(np.float32), rng.integers(0, gru.OTHER + 1, 5000)
    heads = model.heads()
    assert heads.narrow
    plain = model.log_probability(h, goals)
    assert np.allclose(plain, model.log_probability(h, goals, gru.Heads(heads.classes, heads.words, False)), atol=1e-4)
    scores = (h @ model.to_class + model.class_bias).astype(float)
    assert np.allclose(model.log_probability(h, np.full(5000, gru.OTHER)), scores[:, -1] - np.log(np.exp(scores).sum(axis=1)), atol=1e-4)
    model.to_word *= 100
    assert not model.heads().narrow and np.isfinite(model.log_probability(h, goals)).all()


def test_gru_gradients_and_carried_state():
    rng = np.random.default_rng(0)
    model = gru.Model.start(rng.integers(1, 50, gru.WORDS).astype(float), 30.0)
    model = model.like(model.flat() + rng.standard_normal(model.flat().size) * 0.1)
    end = 7
    text = np.array([1, 5, gru.OTHER, 900, 33, 2, end])
    whole = gru.score(model, [text, text[3:]], end, window=32)
    assert np.allclose(whole, gru.score(model, [text, text[3:]], end, window=2), rtol=1e-4)
    # all probabilities of one step sum to one
    h = np.full((gru.WORDS + 1, gru.HIDDEN), 0.3, np.float32)
    assert math.isclose(np.exp(model.log_probability(h, np.arange(gru.WORDS + 1))).sum(), 1, rel_tol=1e-4)
    trainer = gru.Trainer(model.like(model.flat()))
    caught = []
    trainer._update = caught.append
    inputs, targets = np.concatenate([[end], text[:-1]])[:, None], text[:, None]
    trainer.window(inputs, targets, np.zeros((1, gru.HIDDEN), np.float32), end)
    loss = lambda m: -gru.score(m, [text], end)[0] / len(text)
    for part, gradient in enumerate(caught[0]):
        i = int(np.abs(gradient).argmax())
        sides = []
        for step in (1e-2, -1e-2):
            moved = model.like(model.flat())
            moved.parts()[part].ravel()[i] += step
            sides.append(loss(moved))
        assert math.isclose((sides[0] - sides[1]) / 2e-2, gradient.ravel()[i], rel_tol=0.05, abs_tol=1e-4)


def test_gru_learns_what_follows_what():
    end, rng = 0, np.random.default_rng(2)
    text = np.concatenate([[1 + 2 * i, 2 + 2 * i] for i in rng.integers(0, 8, 20_000)] + [[end]])
    counts = np.bincount(text, minlength=gru.WORDS).astype(float)
    start = gru.Model.start(counts, 1.0)
    trainer = gru.Trainer(start.like(start.flat()))
    for _ in range(6):
        trainer.text(text, end)
    assert gru.score(trainer.model, [text[-400:]], end)[0] > 0.85 * gru.score(start, [text[-400:]], end)[0]


def test_the_vocabulary_grows_with_the_corpus(spark, monkeypatch):
    """Words beyond the smallest model's places are listed, and their context counts."""
    rng = np.random.default_rng(4)
    pairs = [f"a{i} b{i}" for i in range(900)]  # 1,800 words, each b after its own a
    rows = [(i, " ".join(pairs[j] for j in rng.integers(0, 900, 300))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    started = []
    start = gru.Model.start
    monkeypatch.setattr(gru.Model, "start", lambda *a: started.append(start(*a)) or started[-1])
    assert lm.scores(frame).count() == 60
    model = started[0]
    assert model.other == 1801  # all words and the end
    assert model.class_of[-1] <= math.sqrt(model.other) + 1 and np.diff(model.ends).min() > 0
    assert np.isclose(np.exp(model.log_probability(np.zeros((1802, gru.HIDDEN), np.float32), np.arange(1802))).sum(), 1, rtol=1e-4)
    assert lm.least_count(4_000_000) == 40 and lm.least_count(0) == 1
    assert lm.most_listed(0) == 4096 and lm.most_listed(130_000_000) == 8105 and lm.most_listed(27 * 10**12) == 480_000


def test_a_hot_anchor_is_split(spark, monkeypatch):
    """A line shorter than a window in all texts: no task sorts all its contexts, results stay whole."""
    rng = np.random.default_rng(6)
    make = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    line, tail, long = make(120), make(100), make(260)
    texts = [make(150) + line + (tail if i % 20 == 0 else "") + make(150) for i in range(300)]
    texts += [make(140 + i % 7) + long + make(150) for i in range(200)] + texts[:2] + texts[-2:]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    settle, most = suffix_dedup.settle, 20_000
    monkeypatch.setattr(suffix_dedup, "HELD_BYTES", most)

    def watched(contexts, open_, length):
        assert sum(map(len, contexts)) < 3 * most
        return settle(contexts, open_, length)

    monkeypatch.setattr(suffix_dedup, "settle", watched)
    want = {i: int(m.sum()) for i, m in enumerate(removed([t.encode() for t in texts], 200, lambda s, i, n: s[i : i + n]))}
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.duplicate_bytes(frame).collect()}
    assert got == want and sum(n > 0 for n in want.values()) > 200


def test_small_edits_are_found(spark):
    """One and three changed words of 248: which documents were found, not only how many."""
    from veta.llm import queries
    rng = np.random.default_rng(8)
    make = lambda: [f"w{i}" for i in rng.integers(0, 5000, 248)]
    rows = []
    for i in range(100):
        base = make()
        rows.append((10 * i, " ".join(base)))
        for changed in (1, 3):
            other = list(base)
            for j in rng.choice(248, changed, replace=False):
                other[j] = "new"
            rows.append((10 * i + changed, " ".join(other)))
    found = fingerprints.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string"))
    asked = found.filter("doc_id % 10 = 0")
    classes = fingerprints.near_classes(found, asked, queries.NEAR_BITS)
    got = {(r["doc_id"], r["found_id"]) for r in classes.join(fingerprints.members(found), ["fp", "fp2"]).collect()}
    assert all(a // 10 == b // 10 for a, b in got)
    share = {c: sum((10 * i, 10 * i + c) in got for i in range(100)) for c in (0, 1, 3)}
    print("found of 100", share)
    assert share[0] == 100 and share[1] >= 95 and share[3] >= 70
    near = {(r["fp"], r["fp2"]): r["n_near"] for r in fingerprints.near_counts(found, asked, queries.NEAR_BITS).collect()}
    for r in asked.collect():
        assert near[r["fp"], r["fp2"]] == sum(a == r["doc_id"] for a, _ in got)


def test_ranges_of_repeated_rows_are_listed_once(spark):
    from veta.llm import windows
    keyed = windows.keyed(spark.createDataFrame([(1, "a b c")] * 20, "doc_id bigint, text string"), "doc_id", "text")
    ranges = keyed.select(F.col("_d").alias("d"), F.col("_t").alias("t"), F.lit(0).alias("lo"), F.lit(1).alias("hi"))
    assert [len(r["_ranges"]) for r in windows.with_ranges(keyed, ranges).collect()] == [1] * 20


def test_unequal_long_words_are_told_apart(spark):
    """Words of the Thue-Morse sequence and of its complement: equal under any polynomial modulo 2**64."""
    bits = [i.bit_count() % 2 for i in range(1024)]
    one, other = ("".join("ab"[b ^ flip] for b in bits) for flip in (0, 1))
    rest = " ".join(f"w{i}" for i in range(34))
    frame = spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {other}"), (3, f"{other} {rest}"), (4, f"{other} {rest}")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.duplicate_words(frame).collect()}
    assert got == {1: 0, 2: 0, 3: 35, 4: 35}
    hashes = {w: int(h) for w, h in zip([one, other], windows.word_tokens(f"{one} {other}"))}
    assert len(set(hashes.values())) == 2
    assert len(set(windows.word_tokens("ab ba a aa b \u00e9 abc ab").tolist())) == 7


def test_one_of_each_group_on_hard_rows(data, docs, none):
    found = {}
    for r in simhash_dedup.near_duplicates(docs).collect():
        found.setdefault(r["root"], []).append(r)
    kept = simhash_dedup.one_of_each(docs).collect()
    assert len(kept) == len(found) and simhash_dedup.one_of_each(none).count() == 0
    rows = {key(r) for r in data}
    assert all(key(tuple(r)) in rows for r in kept)
    assert sorted(key((r["doc_id"],)) for r in kept) == sorted(key((g[0]["component_id"],)) for g in found.values())


def test_hot_anchors_stay_where_they_are(data, docs, monkeypatch):
    """With all keys shuffled, and with all keys taken for hot, the same bytes go."""
    got = []
    for share in (1, 1 << 40):
        monkeypatch.setattr(windows, "HOT", share)
        got.append(sorted(map(tuple, suffix_dedup.duplicate_bytes(docs, length=20, gram=8).collect()), key=key))
    assert got[0] == got[1] and any(r[2] for r in got[0])
