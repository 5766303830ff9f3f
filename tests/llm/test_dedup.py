"""Deduplication operators against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from roadglass.llm.exact_dedup import exact_dedup
from roadglass.llm.line_dedup import line_dedup
from roadglass.llm.simhash import LEVELS, fingerprint, hamming_links, shard_links, simhash_components
from roadglass.llm.substring_dedup import CHUNK, LENGTH, substring_dedup
from roadglass.llm.suffix_sort import suffix_array

SCHEMA = "doc_id long, text string, kept boolean, level string, name string, row int, _text string"


def table(spark, rows):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "x", "y", 7, "z") for i, t in rows], SCHEMA).repartition(3)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus():
    rng = random.Random(5)
    words = ["Alpha", "beta", "Gamma", "delta", "Été", "été", "ΣΑΣ", "K", "x"]
    long = " ".join(rng.choice(words) for _ in range(4000))
    rows = [(1, None), (2, ""), (3, "Same"), (4, "sAME"), (5, "SAME "), (6, long), (7, long.upper()), (8, lower(long)), (9, long + "."), (10, "Été"), (11, "été"), (None, "Same"), (None, "lost"), (12, "twice"), (12, "twice")]
    return rows + [(100 + k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))) for k in range(60)]


def check_exact(spark, **options):
    rows = corpus()
    got = sorted((tuple(r) for r in exact_dedup(table(spark, rows), **options).collect()), key=str)
    groups = {}
    for i, t in rows:
        groups.setdefault(lower(t), []).append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    assert sorted(((i, best[lower(t)], len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in rows), key=str) == sorted(((g[0], g[1], g[2], g[4]) for g in got), key=str)
    assert all(g[0] == g[1] for g in got if g[3])
    assert sum(g[3] for g in got) == len(groups)


def test_exact_dedup(spark):
    check_exact(spark)


def test_exact_dedup_small_blocks(spark):
    check_exact(spark, block_bytes=64)


def test_exact_dedup_with_a_hash_that_collides(spark):
    check_exact(spark, block_bytes=64, hasher=lambda b: (F.octet_length(b).cast("long"), F.lit(1).cast("long")))


def test_exact_dedup_empty(spark):
    assert exact_dedup(table(spark, [])).count() == 0


def brute_lines(rows):
    space = " \t\n\x0b\x0c\r"
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(lower(line.strip(space)), set()).add(-1 if i is None else i)
    gone = {k: max(v) for k, v in held.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if (k := lower(x.strip(space))) not in gone or gone[k] == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(3)
    pool = [f"Shared line number {k} of the pool" for k in range(12)] + ["short", "", "  Padded shared line of the pool\t", "é" * 20]
    rows = [(k, "\n".join(rng.choice(pool) if rng.random() < 0.5 else f"own line {k} {j} {rng.random()}" for j in range(rng.randrange(1, 150)))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "\n\n"), (None, pool[0] + "\n" + pool[1]), (None, pool[0]), (53, pool[2]), (53, pool[2] + "\nmore")]
    for run in (50_000, 40, 1):  # with runs of one line every repeated line competes in the second round
        got = sorted((tuple(r) for r in line_dedup(table(spark, rows), run=run).collect()), key=str)
        assert got == brute_lines(rows)


def test_line_dedup_of_a_line_that_most_documents_hold(spark):
    rows = [(k, f"a very common line of text\nown line of document {k}, which is long") for k in range(1500)]
    got = sorted((tuple(r) for r in line_dedup(table(spark, rows)).collect()), key=str)
    assert got == brute_lines(rows)
    assert sum(g[2] for g in got) == 1499


def test_line_dedup_empty(spark):
    assert line_dedup(table(spark, [])).count() == 0


def test_suffix_array():
    rng = np.random.default_rng(1)
    for n, letters in ((0, 2), (1, 2), (2, 1), (50, 1), (300, 2), (2000, 3), (3000, 250)):
        text = rng.integers(0, letters, n).astype(np.uint8)
        data = text.tobytes()
        depth = 64
        got = suffix_array(text, depth)
        assert sorted(got.tolist()) == list(range(n))
        cut = [data[i : i + depth] for i in got]
        assert cut == sorted(cut)


def brute_spans(rows):
    places = {}
    texts = [(t or "").encode() for _, t in rows]
    for d, t in enumerate(texts):
        for i in range(len(t) - LENGTH + 1):
            places.setdefault(t[i : i + LENGTH], []).append((d, i))
    marks = [bytearray(len(t)) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for d, i in where:
                marks[d][i : i + LENGTH] = b"\1" * LENGTH
    out = []
    for (i, _), t, m in zip(rows, texts, marks, strict=True):
        runs = sum(1 for k in range(len(m)) if m[k] and (k == 0 or not m[k - 1]))
        out.append((i, len(t), sum(m), runs, bytes(b for b, x in zip(t, m, strict=True) if not x)))
    return sorted(out, key=str)


def repeats():
    rng = random.Random(9)
    draw = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared, other = draw(500), draw(230)
    base = draw(3000)
    rows = [(1, draw(400) + shared + draw(300)), (2, shared + draw(250)), (3, draw(10) + shared[100:450]), (4, base), (5, base[:1400] + "#" + base[1400:]), (6, base[:700] + "?" + base[702:2500]), (7, "z" * 900), (8, "z" * 150), (9, None), (10, ""), (11, other + draw(50) + other), (12, shared[:199]), (13, base), (13, base), (None, draw(300)), (14, "ab" * 400), (15, "ab" * 120 + draw(100))]
    return rows + [(20 + k, draw(120) + other + draw(120)) for k in range(12)]


def test_substring_dedup(spark):
    rows = repeats()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup(table(spark, rows)).collect()), key=str)
    assert got == brute_spans(rows)


def test_substring_dedup_of_crowded_grams(spark):
    rows = repeats()
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup(table(spark, rows), sorted_at_most=1).collect()), key=str)
    assert got == brute_spans(rows)


def test_substring_dedup_of_a_passage_that_most_documents_hold(spark):
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = draw(320)
    rows = [(k, draw(210) + passage + draw(210)) for k in range(1200)]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup(table(spark, rows)).collect()), key=str)
    assert got == brute_spans(rows)


def test_substring_dedup_across_pieces_of_a_long_text(spark):
    """A text of more than one piece; a shared passage lies across the end of the first."""
    rng = random.Random(12)
    draw = lambda n: "".join(rng.choices("abcdefghijklmnop ", k=n))
    passage = draw(700)
    rows = [(1, draw(CHUNK - 300) + passage + draw(9000)), (2, draw(100) + passage + draw(100)), (3, draw(CHUNK + 50))]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substring_dedup(table(spark, rows)).collect()), key=str)
    assert got == brute_spans(rows)
    assert [g[2] for g in got] == [700, 700, 0]


def test_substring_dedup_empty(spark):
    assert substring_dedup(table(spark, [])).count() == 0


def brute_components(values):
    up = list(range(len(values)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def clouds(rng, n):
    """Fingerprints with chains and clumps of near ones."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        v = rng.choice(out[-n:])
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            v ^= 1 << b
        out.append(v)
    seed = rng.getrandbits(64)
    out += [seed ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(a)]
    return sorted(set(out))


def test_shard_links():
    rng = random.Random(4)
    for n in (1, 5, 400, 900):
        values = clouds(rng, n)
        rng.shuffle(values)
        got = shard_links(np.array(values, np.uint64))
        want = brute_components(values)
        assert len(set(zip(got.tolist(), want, strict=True))) == len(set(want)) == len(set(got.tolist()))


def test_hamming_links_with_split_shards(spark):
    from roadglass.llm.components import connected_components

    values = clouds(random.Random(6), 300)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    want = brute_components(signed_to_unsigned := values)
    for split, shard in ((20_000, 4096), (20_000, 20), (20, 20), (3, 4096)):
        nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
        found = {r["node"]: r["root"] for r in connected_components(hamming_links(nodes, split=split, shard=shard)).collect()}
        roots = [found.get(v, v) for v in signed]
        assert len(set(zip(roots, want, strict=True))) == len(set(want)) == len(set(roots))
    assert signed_to_unsigned


def test_no_plan_of_the_components_holds_a_star_twice(spark, monkeypatch, capsys):
    from roadglass.llm import components

    told = []

    def held(df, name, cut=components.cut):
        df.explain()
        told.append(capsys.readouterr().out.count("Exchange "))
        return cut(df, name)

    monkeypatch.setattr(components, "cut", held)
    edges = spark.createDataFrame([(k, k + 1) for k in range(8)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == dict.fromkeys(range(9), 0)
    assert len(told) > 2 and max(told) <= 6, told


def test_vantage_trees_prune_on_the_documents(spark):
    """On the fingerprints of sf0.1 the trees decide what is compared, and the links are those of all pairs."""
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").distinct()
    fps = np.unique(np.array([fingerprint(r["text"]) for r in texts.toLocalIterator()], np.uint64))
    want = np.arange(len(fps))
    forest = list(range(len(fps)))

    def find(i):
        while forest[i] != i:
            i = forest[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 4).tolist():
            a, b = find(i), find(j)
            forest[max(a, b)] = min(a, b)
    want = [find(i) for i in range(len(fps))]
    tally, linked, start = Counter(), set(), 0
    for w in LEVELS[0]:
        codes = fps >> np.uint64(64 - start - w) & np.uint64((1 << w) - 1)
        start += w
        root = shard_links(fps, codes, tally=tally)
        linked |= {(i, r) for i, r in enumerate(root.tolist()) if i != r}
    forest = list(range(len(fps)))
    for i, j in linked:
        a, b = find(i), find(j)
        forest[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == want
    assert tally["nodes"] > 1000 and tally["pruned"] > 500
    assert tally["compared"] < 0.02 * 5 * len(fps) ** 2 < tally["left out"]


def test_fingerprints_use_the_hash_of_spark(spark):
    assert spark.sql("select xxhash64('a b c d') as h").first()["h"] & (2**64 - 1) == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert fingerprint("A b\tC\n d") == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert fingerprint("a b") == xxhash.xxh64_intdigest(b"a b", 42)
    assert fingerprint(None) == fingerprint(" \n") == 0


def brute_fingerprint(text):
    words = lower(text).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_of_a_very_long_text():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(70_000))
    assert fingerprint(text) == brute_fingerprint(text)


def test_simhash_components(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(500)]
    base = [[rng.choice(words) for _ in range(120)] for _ in range(6)]
    rows = [(None, None), (90, ""), (91, None), (92, " \t"), (93, "one"), (94, "ONE"), (95, base and " ".join(base[0])), (95, " ".join(base[0]))]
    for k in range(40):
        text = list(rng.choice(base))
        if rng.random() < 0.7:
            text[rng.randrange(120)] = "changed"
        rows.append((k, " ".join(text)))
    got = {(r[0], r[1], r[2]) for r in simhash_components(table(spark, rows)).collect()}
    values = [brute_fingerprint(t or "") for _, t in rows]
    roots = brute_components(values)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == {(i, f"{v:016x}", least.get(r)) for (i, _), v, r in zip(rows, values, roots, strict=True)}


def test_simhash_empty(spark):
    assert simhash_components(table(spark, [])).count() == 0
