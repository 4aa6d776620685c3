"""Every operator against a brute-force version on small hard cases."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from prosegauge.llm import (
    components,
    decontamination,
    fingerprints,
    joins,
    language_id,
    license_templates,
    licenses,
    line_dedup,
    mixing,
    quality,
    simhash,
    similar,
    sketch,
    substring_dedup,
    token_counts,
)

WS = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = "doc_id long, text string, source string, digest string"


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def prose(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared lines and passages, nulls, empties, odd white
    space, one very long text, repeated rows, a clashing column name."""
    rng = random.Random(5)
    base = prose(rng, 120)
    shared = prose(rng, 40)
    texts = [None, "", " \n\t", "É É X", "one", "Two words", base, base, base.upper()]
    texts += [base.replace("w1 ", "changed ", 1), base + " tail", shared, prose(rng, 30) + " " + shared + "\n" + prose(rng, 20)]
    texts += [f"Boilerplate Line \n{prose(rng, 30)}\n\tboilerplate line\r\nrow {k % 3}" for k in range(12)]
    texts += [prose(rng, 9000, 5000), shared + " x " + shared]
    out = [(k, t, (None, "a", "b", "c")[k % 4], "clash") for k, t in enumerate(texts)]
    return out + [out[-1]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, TEXT).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TEXT)


# ---- line dedup -------------------------------------------------------------


def lines_by_hand(rows, min_docs, keep_first=False):
    key = lambda s: ascii_lower(s.strip(" \t\n\x0b\x0c\r"))
    found, first = defaultdict(set), {}
    for d, t, *_ in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((t or "").split("\n")):
            found[key(line)].add(d)
            first.setdefault(key(line), (d, k))
    gone = {k for k, ds in found.items() if k and len(ds) >= min_docs}
    out = []
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [s for k, s in enumerate(lines) if key(s) not in gone or keep_first and first[key(s)] == (d, k)]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.mark.parametrize("keep_first,bound,suspects", [(False, 500_000, 1 << 20), (True, 500_000, 0), (True, 0, 1 << 20), (False, 0, 0)])
def test_lines(docs, rows, keep_first, bound, suspects):
    got = line_dedup.dedup_lines(docs, min_docs=4, keep_first=keep_first, broadcast_keys=bound, most_suspects=suspects)
    assert got.columns == ["doc_id", "text", "source", "digest", "n_lines", "n_dropped", "kept_text"]
    assert sorted(tuple(r) for r in got.select("doc_id", "n_lines", "n_dropped", "kept_text").collect()) == lines_by_hand(rows, 4, keep_first)


def suspected(spark, hashes, cells=None, rows=2):
    def gathered(batches):
        held = sketch.Gathered()
        for batch in batches:
            yield from held.add(batch.column(0).to_numpy().view(np.uint64))
        yield from held.flush()

    frame = spark.createDataFrame([(int(h),) for h in hashes], "h long").repartition(3)
    return sketch.suspects(frame.mapInArrow(gathered, sketch.HASHES), len(hashes), rows, cells)


def test_no_repeated_hash_is_missed(spark):
    rng = np.random.default_rng(1)
    many = rng.integers(-(1 << 63), 1 << 63, 6000)
    twice = set(many[:500].tolist())
    hashes = np.concatenate([many, many[:500], np.repeat(many[:1], 300)])
    for cells in (None, 1024):
        found = suspected(spark, hashes, cells)
        got = {r["hash"]: r["count"] for r in found.collect()}
        assert got.keys() >= twice and got[int(many[0])] > 100
        assert len(got) < 700 or cells
        held = sketch.Filter.of(found).holds(many.view(np.uint64))
        assert held[:500].all() and (cells or held[500:].mean() < 0.1)
    assert sketch.Filter.of(found, most=10) is None
    # hashes that are small, as least ones of several are, fill the filter evenly all the same
    small = (rng.integers(0, 1 << 63, 40_000) >> 8).astype(np.int64)
    frame = spark.createDataFrame([(int(h), 1) for h in small[:20_000]], "hash long, count long")
    held = sketch.Filter.of(frame).holds(small.view(np.uint64))
    assert held[:20_000].all() and held[20_000:].mean() < 0.1


def test_sketches_hold_at_thirty_times_the_load(spark, monkeypatch):
    """The share of suspects stays near the true one, as more tasks take the hashes."""
    monkeypatch.setattr(sketch, "A_TASK", 2000)
    rng = np.random.default_rng(2)
    shares = []
    for n in (2000, 60_000):
        once = rng.integers(-(1 << 63), 1 << 63, n)
        shares.append(suspected(spark, np.concatenate([once, once[: n // 20]])).count() / n)
    assert all(0.05 <= x < 0.08 for x in shares)


# ---- mixing -----------------------------------------------------------------


def test_mix(spark, docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s, _ in rows:
        sizes[s] += len(WS.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(order, mixing.share_targets([sizes[s] for s in order], [5, 2, 1, 5], sum(sizes.values()), 3)))
    taken = Counter()
    for r in got:
        assert r["size"] == len(WS.findall(r["text"] or ""))
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(3)
    many = [(k, prose(rng, rng.randrange(1, 60)), "hot" if k % 3 else f"s{k % 4}", "") for k in range(3000)]
    taken, target = Counter(), {}
    for r in mixing.mix(spark.createDataFrame(many, TEXT)).collect():
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= 60


def test_documents_without_id_are_not_taken_together(spark):
    rng = random.Random(30)
    rows = [(None, prose(rng, 20), "a", "") for _ in range(200)] + [(k, prose(rng, 20), "b", "") for k in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, TEXT)).where("source = 'a'").collect()
    assert abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 40 and len({r["taken"] for r in got}) == 2


def test_targets_are_shared_again():
    assert mixing.share_targets([10, 1000], [1, 1], 1010, 3) == [30, 980]
    assert mixing.share_targets([0, 0], [5, 2], 0, 3) == [0, 0]
    assert sum(mixing.share_targets([1, 2, 300, 4], [5, 2, 1, 5], 307, 3)) == pytest.approx(307)


# ---- token counts -----------------------------------------------------------


def viterbi(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(e):
            if word[s:e] in scores:
                best[e] = max(best[e], (best[s][0] + scores[word[s:e]], -(-best[s][1] + 1)), key=lambda x: (x[0], x[1]))
    return -best[-1][1]


def test_trie_counts_equal_viterbi():
    rng = random.Random(2)
    scores = {bytes([b]): -9.0 for b in range(256)} | {"".join(rng.choices("abc", k=n)).encode(): -rng.random() * 8 for n in range(2, 6) for _ in range(12)}
    counter = token_counts.Counter(scores)
    words = ["".join(rng.choices("abcd", k=rng.randrange(1, 14))).encode() for _ in range(400)] + [b"abc" * 200]
    counter.learn(words)
    for w in words:
        segments = viterbi(w, scores)
        assert counter.known[w] == segments
    # one node for each distinct prefix
    counter.learn([b"dog", b"dogs", b"do", b"cat"] if b"dog" not in counter.known else [])
    assert len(counter.best) == 1 + len({w[:k] for w in (b"dog", b"dogs", b"do", b"cat") if w not in words for k in range(1, len(w) + 1)})


def test_pre_tokens_deeper_than_the_trie(monkeypatch):
    monkeypatch.setattr(token_counts, "DEPTH", 7)
    rng = random.Random(22)
    scores = {bytes([b]): -9.0 for b in range(256)} | {"".join(rng.choices("ab", k=n)).encode(): -rng.random() * 8 for n in range(2, 9) for _ in range(8)}
    words = ["".join(rng.choices("abc", k=n)).encode() for n in (3, 7, 8, 9, 30, 5000, 9000)]
    counter = token_counts.Counter(scores)
    counter.learn(words)
    for w in words[:5]:
        assert counter.known[w] == viterbi(w, scores)
    deep = token_counts.Counter(scores)
    monkeypatch.setattr(token_counts, "DEPTH", 100_000)
    deep.learn(words)
    assert deep.known == counter.known


def test_token_query(spark, docs, rows, empty, tmp_path):
    ranks = tmp_path / "ranks"
    import base64

    pieces = [bytes([b]) for b in range(256)] + [b" w", b"w1", b" w1", b"changed"]
    ranks.write_text("".join(f"{base64.b64encode(p).decode()} {k}\n" for k, p in enumerate(pieces)))
    scores = token_counts.load_scores(str(ranks))
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, str(ranks)).collect()}
    for d, t, *_ in rows:
        words = token_counts.PRE_TOKEN.findall((t or "").encode())
        assert b"".join(words) == (t or "").encode()
        assert got[d]["n_pretokens"] == len(words) and got[d]["n_tokens"] == sum(viterbi(w, scores) for w in words)
    assert token_counts.count_tokens(empty, str(ranks)).count() == 0


# ---- SimHash ----------------------------------------------------------------


def simhash_by_hand(t, k=3):
    w = WS.findall(ascii_lower(t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def union(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows):
    prints = {d: simhash_by_hand(t) for d, t, *_ in rows}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    of = union(near, prints)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted(
        (d, f"{prints[d]:016x}", of[d]) for d, *_ in rows
    )


@pytest.mark.parametrize("block", [4096, 3])
def test_links_of_crowded_buckets(spark, block):
    """Thousands of close fingerprints; small blocks must not lose a link."""
    rng = random.Random(8)
    near = {0x0123456789ABCDEF}
    while len(near) < 300:
        near.add(rng.choice(sorted(near)) ^ (1 << rng.randrange(12)) ^ (1 << rng.randrange(64)))
    far = {rng.getrandbits(64) for _ in range(200)}
    values = sorted(near | far)
    nodes = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, k) for k, v in enumerate(values)], "fp0 long, rep long").repartition(3)
    edges = simhash.links(nodes, block=block)
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    near = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 3]
    assert {n: got.get(n, n) for n in range(len(values))} == union(near, range(len(values)))
    assert edges.count() < 8 * len(values) * 4


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 300)] + [(3, 3), (None, 5)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(80)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == union(real, {n for e in real for n in e})
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles_by_hand(t, k=5):
    w = WS.findall(ascii_lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_similar_documents(spark):
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(60, 300))]
        texts.append(words)
        for edits in (1, 2, 4):
            copy = list(words)
            for _ in range(edits):
                copy[rng.randrange(len(copy))] = f"new{rng.random()}"
            texts.append(copy)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(1000, None), (1001, " "), (1002, "short one"), (1003, "SHORT one")]
    sets = {k: shingles_by_hand(t) for k, t in rows}
    alike = lambda a, b: a == b or len(a & b) / max(1, len(a | b)) >= 0.8
    near = [(a, b) for a, b in itertools.combinations(sets, 2) if alike(sets[a], sets[b])]
    want = union(near, sets)
    got = {r["doc_id"]: r["component_id"] for r in similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_similar_documents_of_repeated_ids_and_hot_texts(spark):
    """A third of all rows are one text, another third near copies of one text; an id
    with two texts joins their groups; rows without an id take no part."""
    rng = random.Random(16)
    fresh = lambda n: " ".join(f"w{rng.getrandbits(50)}" for _ in range(n))
    base, hot, other = fresh(90), fresh(50), fresh(70)
    rows = [(k, hot) for k in range(1000, 1400)] + [(k, base + f" tail{k}") for k in range(2000, 2400)]
    rows += [(k, fresh(40)) for k in range(3000, 3300)] + [(7, base), (7, other), (4, other + " more"), (5, fresh(9)), (None, other), (None, hot)]
    rows += [(2000, hot), (6, "")]
    want = {k: k for k, _ in rows if k is not None} | {k: 4 for k in (4, 7, *range(2000, 2400), *range(1000, 1400))}
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = similar.similar_documents(frame.selectExpr("*", "1 AS node", "2 AS n")).collect()
    assert len(got) == len(rows) - 2 and {r["doc_id"]: r["component_id"] for r in got} == want


def test_only_sets_that_share_their_beginnings_are_looked_at(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    passage = fresh(30)
    rows = [(k, " ".join(fresh(200) + (passage if k % 2 else []))) for k in range(300)]
    rows += [(k, " ".join(x)) for k in range(400, 440, 2) for own in [fresh(120)] for k, x in ((k, own), (k + 1, own[:-4]))]
    prints = similar.beginnings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 0.8)
    got = {r["rep"] for r in similar.with_partners(prints, 0.8).collect()}
    assert got >= set(range(400, 440)) and len(got) < 60


def test_a_hot_key_is_joined_where_it_is(spark):
    rows = spark.createDataFrame([(k % 7 if k < 70 else 100, k) for k in range(1000)] + [(None, -1), (55, -2)], "key long, x long")
    table = rows.where("key <> 55").groupBy("key").count().withColumn("y", F.col("key") + 1)
    for how, n in (("inner", 1000), ("left", 1002)):
        got = joins.join_counted(rows, table, ["key"], total=1000, how=how).collect()
        assert len(got) == n and all(r["y"] == r["key"] + 1 for r in got if r["x"] >= 0) and all(r["y"] is None for r in got if r["x"] < 0)
    assert joins.only(rows, rows.where("key = 100").select("key").distinct(), "key").count() == 930
    assert joins.only(rows, rows.where("key = 100").select("key").distinct(), "key", keep=False).count() == 72


def groups_by_hand(rows):
    sets = {k: shingles_by_hand(t) for k, t in rows}
    of = {}
    for k, x in sets.items():
        for s in x:
            of.setdefault(s, set()).add(k)
    near = {
        (a, b) for a, x in sets.items() for b in {k for s in x for k in of[s]} if a < b and 5 * len(x & sets[b]) >= 4 * len(x | sets[b])
    }
    return union(near, sets)


def test_similar_documents_over_crowded_buckets_and_bridges(spark):
    """Texts with a long shared passage at a similarity just under 0.8, and among them
    pairs and chains a, c, b where only c is similar to both."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    passage, texts = fresh(200), []
    for _ in range(500):
        texts.append(passage + fresh(28))
    for _ in range(40):
        own = fresh(28)
        texts += [passage + own, passage[:-6] + fresh(6) + own]
    for _ in range(40):
        middle = fresh(200)
        texts += [fresh(18) + middle[18:], middle[:-18] + fresh(18), middle]
    rng.shuffle(texts)
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), block=256).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == groups_by_hand(rows)


def test_similar_documents_at_the_threshold(spark):
    """Isolated pairs at a similarity of exactly 0.8 or little more, short and long."""
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.getrandbits(60)}" for _ in range(n)]
    rows = []
    for k in range(300):
        shared = fresh(rng.choice([4, 8, 16, 80, 160]) + 4)
        n = (len(shared) - 4) // 8
        rows += [(2 * k, " ".join(shared + fresh(n))), (2 * k + 1, " ".join(shared + fresh(n)))]
    want = groups_by_hand(rows)
    assert sum(want[2 * k + 1] == 2 * k for k in range(300)) == 300
    got = similar.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


# ---- fingerprints -----------------------------------------------------------


def test_fingerprints(docs, rows):
    order = sorted(rows, key=lambda r: -r[0])
    got = fingerprints.with_neighbours(docs, ranges=5).collect()
    want = {}
    for (d, t, *_), (_, following, *_) in zip(order, order[1:] + order[:1]):
        t, following = t or "", following or ""
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        own, changed, after = (fingerprints.fingerprint(x.encode()) for x in (t, new, following))
        want.setdefault(d, []).append((len(t), hashlib.sha256(new.encode()).hexdigest(), own, changed, fingerprints.likeness(own, changed), fingerprints.likeness(own, after)))
    have = defaultdict(list)
    for r in got:
        have[r["doc_id"]].append(tuple(r)[1:])
    assert {d: sorted(x) for d, x in have.items()} == {d: sorted(x) for d, x in want.items()}


def test_neighbours_of_hot_ids(spark):
    """A third of all rows have one id, a third none: they are dealt to many ranges."""
    rng = random.Random(19)
    rows = [(7 if k < 300 else None if k < 600 else k, prose(rng, 12, 9000)) for k in range(900)] + [(5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = docs.select(F.bitwise_not(F.coalesce("doc_id", F.lit(fingerprints.NULL_ID))).alias("key"), F.xxhash64("text").alias("tie"))
    bounds = fingerprints._bounds(keyed, 12)
    assert sum(k == ~7 for k, _ in bounds) >= 3 and sum(k == ~fingerprints.NULL_ID for k, _ in bounds) >= 3
    got = fingerprints.with_neighbours(docs, ranges=12).collect()
    texts = {d: t for d, t in rows if d not in (7, None)}
    assert len(got) == 901 and Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    order = sorted(texts, reverse=True)
    by_id = {r["doc_id"]: r for r in got}
    for d, following in zip(order, order[1:]):
        changed = fingerprints.edited(texts[d] or "", texts[following] or "")
        assert by_id[d]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
    # following each other, every row but the last has a row of its group or the next as its next
    assert sum(r["near_next"] == 1.0 for r in got) <= 2


def digest_by_hand(data):
    """Counts, quartiles, packing and length step, one byte triplet after another."""

    def bucket(salt, a, b, c):
        x = (a + (b << 8) + (c << 16) + (salt << 24)) * 0x9E3779B1 % (1 << 32)
        x ^= x >> 15
        return x * 0x85EBCA77 % (1 << 32) >> 24

    counts = [0] * 256
    for k in range(len(data) - 2):
        w = data[k : k + 4]
        counts[bucket(1, *w[:3])] += 1
        if len(w) == 4:
            counts[bucket(2, w[0], w[1], w[3])] += 1
            counts[bucket(3, w[0], w[2], w[3])] += 1
    q = [sorted(counts)[k] for k in (63, 127, 191)]
    marks = [sum(c > x for x in q) for c in counts]
    packed = bytes(sum(m << (6 - 2 * j) for j, m in enumerate(marks[k : k + 4])) for k in range(0, 256, 4))
    return f"{min(255, int(math.log2(len(data) + 1) * 8)):02x}" + packed.hex()


def difference_by_hand(a, b):
    marks = lambda d: [x >> s & 3 for x in bytes.fromhex(d[2:]) for s in (6, 4, 2, 0)]
    apart = sum((0, 1, 2, 6)[abs(x - y)] for x, y in zip(marks(a), marks(b)))
    return apart + min(48, 6 * abs(int(a[:2], 16) - int(b[:2], 16)) // 4)


def test_digests_by_hand():
    rng = random.Random(13)
    texts = [b"", b"a", b"ab", b"abc", b"xyz", b"abcd", prose(rng, 50).encode(), prose(rng, 900).encode(), "É ü ".encode() * 40]
    for t in texts:
        assert fingerprints.fingerprint(t) == digest_by_hand(t)
    for a, b in itertools.product(map(digest_by_hand, texts), repeat=2):
        assert fingerprints.difference(a, b) == difference_by_hand(a, b)
        assert fingerprints.likeness(a, b) == (1 if a == b else max(0, 1 - difference_by_hand(a, b) / 385))
    assert digest_by_hand(b"abc") != digest_by_hand(b"xyz")


def test_digest_counts_triplets_in_pieces(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 122, 5000, dtype=np.uint8).tobytes()
    whole = fingerprints.bucket_counts(data)
    monkeypatch.setattr(fingerprints, "PIECE", 97)
    assert (fingerprints.bucket_counts(data) == whole).all() and whole.sum() == 3 * (len(data) - 3) + 1
    assert fingerprints.likeness(*[fingerprints.fingerprint(data)] * 2) == 1.0
    assert 0 <= fingerprints.likeness(fingerprints.fingerprint(data), fingerprints.fingerprint(b"")) < 0.5


# ---- quality ----------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(9)
    good = lambda: ". ".join(" ".join("".join(rng.choices("aeioubcdst", k=rng.randrange(2, 9))) for _ in range(8)) for _ in range(6))
    texts = [(k, good() if k % 3 else re.sub(" ", "!! ", good().upper())) for k in range(300)]
    labels = [(k, int(k % 3 > 0)) for k in range(0, 300, 2)] + [(None, 1), (5000, 0), (1, None)]
    docs = spark.createDataFrame(texts + [(900, None), (901, "")], "doc_id long, text string")
    model = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    held = [k for k in range(300) if k % 2]
    assert np.mean([(got[k] >= 0.5) == (k % 3 > 0) for k in held]) > 0.97
    weights = model.attend(quality.encode(texts[1][1].encode() * 20))[1]
    assert math.isclose(weights.sum(), 1, rel_tol=1e-6) and len(weights) > 5
    none = quality.learn(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert none.score(b"x") == 0.5


def attention_by_hand(p, bags, labels, weight):
    """Loss of gated attention over passages, one number after another."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    row = lambda x, m, k: sum(x[i] * m[i][k] for i in range(len(x)))
    total, scores = 0.0, []
    for bag, y, w in zip(bags, labels, weight):
        hidden = [[math.tanh(row(x, p["e"], k) + p["eb"][k]) for k in range(len(p["eb"]))] for x in bag]
        s = [sum(math.tanh(row(h, p["v"], k)) * sig(row(h, p["u"], k)) * p["w"][k] for k in range(len(p["w"]))) for h in hidden]
        a = [math.exp(x) / sum(map(math.exp, s)) for x in s]
        z = [sum(a[i] * hidden[i][k] for i in range(len(bag))) for k in range(len(p["eb"]))]
        scores.append(sig(sum(z[k] * p["c"][k][0] for k in range(len(z))) + p["cb"][0]))
        total -= w * math.log(scores[-1] if y else 1 - scores[-1])
    return total / len(bags) + quality.DECAY / 2 * float((p["e"] ** 2).sum()), scores


def test_attention_and_its_gradient_by_hand(monkeypatch):
    rng = np.random.default_rng(4)
    shapes = {"e": (5, 4), "eb": (4,), "v": (4, 3), "u": (4, 3), "w": (3,), "c": (4, 1), "cb": (1,)}
    p = {k: rng.normal(0, 0.7, n) for k, n in shapes.items()}
    bags = [rng.normal(0, 1, (n, 5)) for n in (1, 4, 2)]
    labels, weight = np.array([1.0, 0.0, 1.0]), np.array([1.5, 0.5, 1.0])
    loss, gradient = quality.loss_and_gradient(p, bags, labels, weight)
    want, scores = attention_by_hand(p, bags, labels, weight)
    assert math.isclose(loss, want, rel_tol=1e-9)
    for bag, y in zip(bags, scores):
        assert math.isclose(quality.Model(p).attend(bag)[0], y, rel_tol=1e-9)
    for name, g in gradient.items():
        for at in np.ndindex(*shapes[name]):
            ends = []
            for step in (1e-6, -1e-6):
                moved = {k: x.copy() for k, x in p.items()}
                moved[name][at] += step
                ends.append(attention_by_hand(moved, bags, labels, weight)[0])
            assert math.isclose(g[at], (ends[0] - ends[1]) / 2e-6, rel_tol=1e-4, abs_tol=1e-7), (name, at)


def test_encoding_by_hand():
    text = ("Ab 1,\n" * 200).encode() + "é".encode()
    got = quality.encode(text)
    assert len(got) == -(-len(text) // quality.PASSAGE)
    for k, row in enumerate(got):
        piece = text[k * 512 : k * 512 + 512]
        after = text[k * 512 : k * 512 + 513]
        pairs = Counter((quality.CLASS_OF[a], quality.CLASS_OF[b]) for a, b in zip(after, after[1:]))
        for (a, b), n in pairs.items():
            assert math.isclose(row[a * 16 + b], math.sqrt(n / sum(pairs.values())), rel_tol=1e-5)
        assert row[258] == pytest.approx(1 - len(set(piece.split())) / len(piece.split()))


def test_sample_of_whole_rows(spark):
    """The bound is on rows: a row that does not fit is left out, none is cut."""
    docs = spark.createDataFrame([(k, "word " * (110 * (1 + k % 3))) for k in range(60)] + [(0, "word " * 110)] * 500, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(0, 1)], "doc_id long, quality int")
    seen = []
    fit = quality.fit
    quality.fit = lambda bags, labels: seen.append((bags, labels)) or fit(bags, labels, epochs=1)
    try:
        quality.learn(docs, labels, sample_passages=40)
    finally:
        quality.fit = fit
    (bags, y), = seen
    assert sum(map(len, bags)) <= 40 and len(bags) >= 12 and {len(b) for b in bags} <= {2, 3, 4} and set(y) == {0, 1}


# ---- decontamination --------------------------------------------------------


def windows_by_hand(rows, items, one_in=20):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t or ""))
    held = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12)) if w and i is not None else ():
            held[tuple(w[k : k + 13])].add(str(i))
    out = []
    for d, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in held}:
            for k in range(len(w) - n + 1):
                if of := held.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(found), digest, bool(hit) and one_in * len(hit) >= len(w)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_decontamination(spark, docs, rows, bound):
    base, long = rows[6][1], rows[-3][1]
    items = [(1, base), (10, base[:200].upper()), (2, "Two  words!"), (3, None), (4, "..."), (5, "unseen w1 w1"), (2, "Two words"), (None, base)]
    items += [(6, " ".join(long.split()[500:513])), (7, " ".join(long.split()[600:612]) + " other")]
    # rows that repeat an id or have none are judged by their own text
    more = [(9, base, "a", "x"), (9, "two words", "a", "x"), (None, base, None, "x"), (None, "clean", None, None), (9, None, None, None)]
    frame = docs.unionByName(spark.createDataFrame(more, TEXT)).selectExpr("*", "1 AS words", "2 AS k1", "3 AS n_hit", "4 AS start")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(frame, benchmark, broadcast_windows=bound, broadcast_texts=bound).collect()
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(str, ([r[c] for c in names] for r in got))) == sorted(str(list(x)) for x in windows_by_hand(list(rows) + more, items))
    assert all(r["n_hit"] <= r["n_words"] and r["k1"] == 2 and r["source"] in (None, "a", "b", "c") for r in got)
    full = windows_by_hand(list(rows) + more, [x for x in items if x[0] not in (2, 5)])
    assert sorted(r["n_full"] for r in got) == sorted(x[2] for x in full)


def test_only_texts_that_meet_a_fingerprint_are_extended(spark, monkeypatch):
    """One row leaves a text for each of its distinct fingerprints, far fewer than windows."""
    rng = random.Random(15)
    texts = [(k, prose(rng, 300, 50_000)) for k in range(40)]
    frame = spark.createDataFrame(texts, "doc_id long, text string").select(decontamination.words(F.col("text")).alias("words"))
    r = decontamination.with_windows(frame, whole=True).agg(F.sum(F.size("fingerprint")).alias("n"), F.sum(F.size(F.array_distinct("fingerprint"))).alias("kept")).first()
    assert r["n"] == 40 * 288 and r["kept"] < r["n"] / 4


def test_decontamination_of_nothing(spark, docs, rows, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontamination.contamination(docs, none).collect()} == {0}
    assert decontamination.contamination(empty, none).count() == 0


# ---- licences ---------------------------------------------------------------


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/x.txt", "some text\nLicensed under the Apache License, Version 2.0.\nmore"),
        ("a/b/c/y.txt", "nothing here"),
        ("a/b/COPYING.md", "This work is licensed under the\nGNU General Public License, version 3."),
        ("d/z.txt", "license"),
        ("top.txt", None),
        (None, "Licensed under CC BY-NC 4.0."),
        ("a/b/c/y.txt", "nothing here"),
    ]
    got = licenses.scan_licenses(spark.createDataFrame([(p, t, "keep") for p, t in files], "path string, text string, license string"))
    assert sorted((str(r["path"]), r["own_license"], r["license"], r["license_from"]) for r in got.collect()) == sorted(
        [
            ("a/LICENSE", "MIT", "MIT", "file"),
            ("a/b/x.txt", "Apache-2.0", "Apache-2.0", "file"),
            ("a/b/c/y.txt", None, "GPL-3.0", "a/b"),
            ("a/b/c/y.txt", None, "GPL-3.0", "a/b"),
            ("a/b/COPYING.md", "GPL-3.0", "GPL-3.0", "file"),
            ("d/z.txt", None, None, None),
            ("top.txt", None, None, None),
            ("None", "CC-BY-NC-4.0", "CC-BY-NC-4.0", "file"),
        ],
        key=str,
    )


def test_licences_of_deep_paths(spark):
    deep = "/".join(f"d{k}" for k in range(50))
    files = [("LICENSE", "Released under the MIT License."), (f"{deep}/LICENSE", "Licensed under CC BY 4.0."), (f"{deep}/x/y.txt", "text")]
    got = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string")).where("own_license is null").first()
    assert (got["license"], got["license_from"]) == ("CC-BY-4.0", deep)


def test_notices_among_other_words():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.7).scan
    prose = " ".join(f"word{k}" for k in range(60))
    for text, name in (
        ("Copyright (c) Microsoft Corporation. Licensed under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0. See the LICENSE file in the project root for details.", "Apache-2.0"),
        (f"{prose} Released under the MIT License. {prose}", "MIT"),
        ("This\nwork is\nlicensed under\nthe GNU\nGeneral Public\nLicense, version 3.", "GPL-3.0"),
        ("GNU GENERAL PUBLIC LICENSE\n Version 2, June 1991\n\n Copyright (C) 1989", "GPL-2.0"),
        ("Mozilla Public License Version 2.0\n=====", "MPL-2.0"),
        ("MIT License\n\nCopyright (c) 2020 Some One", "MIT"),
        ("BSD 3-Clause License\n\nCopyright (c) 2020", "BSD-3-Clause"),
        (f"{prose} you need a license under version 2.0 of this {prose}", None),
    ):
        assert scan(text)[0] == name, text


def wrapped(text, n):
    words = text.split(" ")
    return "\n".join(" * " + " ".join(words[k : k + n]) for k in range(0, len(words), n))


def test_whole_licences_and_pairs_that_differ_late():
    scan = licenses.Scanner(licenses.TEMPLATES, 0.7).scan
    prose = " ".join(f"word{k}" for k in range(500))
    assert len(licenses.TEMPLATES) >= 20
    for name, texts in licenses.TEMPLATES.items():
        for t in texts:
            for layout in (t, wrapped(t, 9), f"{prose} {t} {prose}", f"Copyright (c) 2020 Jane Doe\n\n{t}\n{prose}", wrapped(f"Copyright 2021 {t}", 11)):
                found = scan(layout)
                assert found[0] == name or t == license_templates.BSD_OPENING, (name, t[:60], found)
    # one paragraph without line breaks, titles and headers of one family
    gnu = [n for n in licenses.TEMPLATES if "GPL" in n]
    for name in gnu:
        title, notice, header = licenses.TEMPLATES[name][0], *sorted(licenses.TEMPLATES[name][1:3], key=len)
        assert scan(f"{title.upper()}\n\n{prose}\n{wrapped(header, 10)}")[0] == name, name
    # the words of a licence, some changed
    changed = license_templates.MIT.replace("Software", "Work").replace("THE AUTHORS", "ACME INC")
    assert scan(changed)[0] == "MIT"
    for text in ("SPDX-License-Identifier: MIT", "// spdx-license-identifier: LGPL-3.0-or-later", "SPDX-License-Identifier: Unknown-1.0"):
        assert scan(text)[0] == {"M": "MIT", "3": "LGPL-3.0"}.get(next((c for c in "M3" if c in text), ""), None)


def test_inheritance_by_a_walk(spark):
    """Against a walk up from each file; hot directories, several licence files, ties."""
    rng = random.Random(18)
    notices = {"MIT": "Released under the MIT License.", "CC-BY-4.0": "Licensed under CC BY 4.0.", None: "nothing"}
    files = []
    for k in range(900):
        depth = rng.randrange(0, 45) if k % 9 == 0 else 2
        folders = "/".join(f"d{rng.randrange(2)}" for _ in range(depth)) if k % 9 == 0 else f"hot/x{k % 2}"
        name = rng.choice(["LICENSE", "copying.txt", "a.txt", "a.txt", "a.txt"]) if k % 9 == 0 else "a.txt"
        files.append((f"{folders}/{name}" if folders else name, notices[rng.choice([*notices])] if name != "a.txt" else "text"))
    files += [("hot/NOTICE", notices["MIT"]), ("hot/LICENSE", notices["CC-BY-4.0"]), ("hot/LICENSE", notices["CC-BY-4.0"]), (None, "x"), ("", None)]
    held = defaultdict(list)
    folder = lambda p: None if p is None else p.rsplit("/", 1)[0] if "/" in p else ""
    names = {v: k for k, v in notices.items()}
    for p, t in files:
        if p and re.match(licenses.LICENCE_FILE, p.rsplit("/", 1)[-1]) and names.get(t):
            held[folder(p)].append(names[t])
    got = licenses.scan_licenses(spark.createDataFrame(files, "path string, text string").repartition(5)).collect()
    assert len(got) == len(files)
    for r in got:
        own, at, want = names.get(r["text"]), folder(r["path"]), None
        while own is None and at is not None and want is None:
            if held.get(at):
                want = (max(held[at]), at)  # both notices have a cosine of 1
            at = at.rsplit("/", 1)[0] if "/" in at else "" if at else None
        assert (r["license"], r["license_from"]) == ((own, "file") if own else want or (None, None)), r


def test_cosine_by_hand():
    scanner = licenses.Scanner(licenses.TEMPLATES, 0.7)
    flat = [(n, licenses.terms(licenses.words_of(t))) for n in sorted(licenses.TEMPLATES) for t in licenses.TEMPLATES[n]]
    vector = lambda bag: {t: c * scanner.idf.get(t, scanner.rare) for t, c in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for passage in ("Released under MIT License", "Licensed under the Apache License", "permission granted, free of charge to any person"):
        v = vector(licenses.terms(licenses.words_of(passage)))
        best = max(sum(v.get(t, 0) * x for t, x in vector(bag).items()) / norm(v) / norm(vector(bag)) for _, bag in flat)
        assert math.isclose(scanner.cosine(licenses.words_of(passage))[1], best, rel_tol=1e-9)


# ---- substring dedup --------------------------------------------------------


def substrings_by_hand(rows, window):
    seen = Counter()
    words = [WS.findall(t or "") for _, t, *_ in rows]
    for w in words:
        seen.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = []
    for (d, *_), w in zip(rows, words):
        gone = {p for k in range(len(w) - window + 1) if seen[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((d, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize(
    "window,bound,cells,suspects", [(35, 500_000, None, 1 << 20), (35, 0, 1024, 1 << 20), (4, 500_000, 1024, 0), (20, 0, None, 1 << 20), (35, 0, None, 0)]
)
def test_substrings(docs, rows, window, bound, cells, suspects):
    got = substring_dedup.dedup_substrings(docs, window=window, broadcast_alarms=bound, cells=cells, most_suspects=suspects)
    assert got.columns == ["doc_id", "text", "source", "digest", "n_words", "n_removed", "kept_text"]
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_text").collect()) == substrings_by_hand(rows, window)


@pytest.mark.parametrize("bound,suspects", [(500_000, 1 << 20), (0, 0)])
def test_substrings_of_repeated_and_missing_ids(spark, bound, suspects):
    rng = random.Random(14)
    shared = prose(rng, 40, 9000)
    rows = [(None, f"{prose(rng, 20, 9000)} {shared}"), (None, prose(rng, 60, 9000)), (1, shared), (1, prose(rng, 50, 9000)), (1, None), (2, f"{shared} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.dedup_substrings(docs, broadcast_alarms=bound, most_suspects=suspects).drop("text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, substrings_by_hand([(str(d), t) for d, t in rows], 35))) or sorted(
        (r["n_words"], r["n_removed"], r["kept_text"]) for r in got
    ) == sorted(x[1:] for x in substrings_by_hand([(str(d), t) for d, t in rows], 35))


def test_rolling_hashes():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    h[30:40] = h[3:13]
    runs = substring_dedup.Rolling(substring_dedup.BASE_A)
    got = runs.runs(runs.prefix(h), 7)
    assert len(got) == 44 and (got[30:34] == got[3:7]).all() and len(set(got.tolist())) == 40
    for width in (1, 2, 3, 20):
        assert substring_dedup.sliding(h, width, np.minimum).tolist() == [min(h[k : k + width].tolist()) for k in range(51 - width)]


# ---- language ---------------------------------------------------------------


def test_language(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "to", "mi", "ne", "ru"], "bb": ["schl", "ung", "ver", "ein", "aus"], "cc": ["ção", "lh", "os", "ei", "quê"]}
    text = lambda lang, n: " ".join("".join(rng.choices(syllables[lang], k=rng.randrange(2, 5))) for _ in range(n))
    rows = [(k, text(lang, rng.randrange(15, 200)), lang) for k, lang in enumerate(["aa", "bb", "cc"] * 60)]
    odd = [(900, None, "aa"), (901, "12 34 !?", "bb"), (902, "", None), (903, text("aa", 9000), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id % 2 = 0"), dict_bytes=8192)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model, reject=False).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902)) and got[903]["lang_pred"] == "aa"
    assert all(got[k]["lang_pred"] == lang and 0 <= got[k]["score"] <= 1 for k, _, lang in rows if k % 2)
    # sizes, choice, score and margin from frames of an independent compressor, piece by piece
    judge = language_id.Judge(model)
    for _, t, _ in rows[1::9] + [(0, text("bb", 900), "bb"), (0, "ka schl", None)]:
        data = language_id.normalised(t).encode()
        sizes = []
        for lang in model:
            content = zstandard.ZstdCompressionDict(model[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            pack = zstandard.ZstdCompressor(dict_data=content, level=6, write_content_size=False, write_dict_id=False)
            packed = [pack.compress(data[k : k + language_id.PIECE]) for k in range(0, len(data), language_id.PIECE)]
            unpack = zstandard.ZstdDecompressor(dict_data=content)
            assert b"".join(unpack.decompress(p, max_output_size=4096) for p in packed) == data
            sizes.append(sum(map(len, packed)))
        assert judge.sizes(data.decode()) == sizes
        best = sizes.index(min(sizes))
        rest = sizes[:best] + sizes[best + 1 :]
        name, score, margin = judge(t)
        assert name == list(model)[best] and math.isclose(margin, (min(rest) - sizes[best]) / min(rest))
        assert math.isclose(score, 1 / (1 + sum(math.exp((sizes[best] - n) / max(4.0, 0.02 * sizes[best])) for n in rest)))
    strict = {r["doc_id"]: r for r in language_id.identify(docs, model, min_margin=0.99).collect()}
    assert strict[1]["lang_pred"] == "und" and strict[1]["rejected"] and strict[1]["score"] == 0
    lax = {r["doc_id"]: r for r in language_id.identify(docs, model, min_margin=0.99, reject=False).collect()}
    assert lax[1]["lang_pred"] == "bb" and lax[1]["rejected"] and lax[1]["score"] > 0
    assert {r["lang_pred"] for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_dictionaries_of_long_texts_and_many_languages(spark):
    long = "".join(f"p{k} " for k in range(40_000))
    took = language_id.evenly(long, 4096)
    assert 3000 < len(took) <= 4096 and "p39086" in took and "p1253" in took and language_id.evenly("short", 4096) == "short"
    docs = spark.createDataFrame([(k, f"word{k} " * 50, f"l{k:03d}") for k in range(300)] + [(900, long, "l000"), (901, long, "l000")], "doc_id long, text string, lang string")
    model = language_id.learn(docs, model_bytes=300 * 256)
    assert len(model) == 300 and sum(map(len, model.values())) <= 300 * 256 and next(iter(model)) == "l000"


def test_a_tie_goes_to_the_most_frequent_language(spark):
    rows = [(k, "same words in both of them", "zz" if k < 7 else "aa") for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs)
    assert {r["lang_pred"] for r in language_id.identify(docs, model, reject=False).collect()} == {"zz"}


# ---- all --------------------------------------------------------------------


def test_repeated_rows_long_texts_and_clashing_names(spark, tmp_path):
    """Every row has an answer, equal rows equal ones, whatever further columns are called."""
    rng = random.Random(23)
    long = prose(rng, 120_000, 50_000)
    texts = [(1, "one two"), (1, "one two"), (1, "other text"), (2, None), (3, ""), (4, long), (4, long), (None, "no id"), (5, "é" * 5000), (6, f"{long} Released under the MIT License.")]
    clash = [(n, k) for k, n in enumerate(("score", "margin", "n_bytes", "n_tokens", "fingerprint", "key", "tie", "part", "ahead", "own_license", "license_from", "_leaf", "row", "words", "of", "count"))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({n: F.lit(k) for n, k in clash}).repartition(3)

    def answers(got, *names):
        rows = got.collect()
        assert len(rows) == len(texts)
        return rows

    ranks = tmp_path / "ranks"
    import base64

    ranks.write_text("".join(f"{base64.b64encode(bytes([b])).decode()} {b}\n" for b in range(256)))
    rows = answers(token_counts.count_tokens(docs, str(ranks)))
    assert sorted(r["n_tokens"] for r in rows) == sorted(len((t or "").encode()) for _, t in texts)
    bags = [quality.encode(b"Good text here. " * 40), quality.encode(b"#!! BAD @@ " * 40)] * 8
    scored = answers(quality.score(docs, quality.fit(bags, np.array([1.0, 0.0] * 8), epochs=4)))
    assert all(isinstance(r["score"], float) and r["words"] == 13 for r in scored)
    by_text = defaultdict(set)
    for r in scored:
        by_text[r["text"] or ""].add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())
    model = {"aa": b"one two three " * 40, "bb": b"w1 w2 w3 other text " * 40}
    found = answers(language_id.identify(docs, model, reject=False))
    assert Counter(r["lang_pred"] == "und" for r in found) == {True: 2, False: 8}
    pairs = answers(fingerprints.with_neighbours(docs, ranges=4))
    assert Counter(r["doc_id"] for r in pairs) == Counter(d for d, _ in texts)
    scanned = answers(licenses.scan_licenses(docs.withColumn("path", F.concat(F.lit("a/b/"), F.col("doc_id").cast("string")))))
    assert [r["doc_id"] for r in scanned if r["own_license"] == "MIT"] == [6] and all(r["row"] == 12 for r in scanned)
    lines = answers(line_dedup.dedup_lines(docs, min_docs=2))
    assert all(r["count"] == 15 for r in lines)
    cut_ = answers(substring_dedup.dedup_substrings(docs, broadcast_alarms=0))
    assert all(r["row"] == 12 for r in cut_) and Counter(r["n_words"] > 0 and r["n_words"] == r["n_removed"] for r in cut_)[True] == 2
    links_ = simhash.near_duplicates(docs).collect()
    assert len(links_) == len(texts) and {r["component_id"] for r in links_ if r["doc_id"] == 4} == {4}



def test_empty_tables(empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    assert mixing.mix(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert similar.similar_documents(empty).count() == 0
    assert fingerprints.with_neighbours(empty).count() == 0
    assert substring_dedup.dedup_substrings(empty).count() == 0
    assert quality.score(empty, quality.Model(None)).count() == 0
    assert licenses.scan_licenses(empty.withColumnRenamed("source", "path")).count() == 0
    assert language_id.learn(empty.withColumnRenamed("source", "lang")) == {}


def test_quality_learning_keeps_no_files(spark, monkeypatch):
    """Which rows are learned from is known by their lengths, so nothing is kept between the two readings."""
    docs = spark.createDataFrame([(k, "ab c. " * (k % 7) * 100 or None) for k in range(40)] + [(1, "ab c. " * 100)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(type(docs), "checkpoint", lambda *a, **b: pytest.fail("a checkpoint"))
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append(bags) or quality.Model(None))
    quality.learn(docs, labels)
    assert sorted(map(len, seen[0])) == sorted(max(1, -(-(k % 7 * 600) // quality.PASSAGE)) for k in range(40))
