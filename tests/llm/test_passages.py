"""Source audit, passage removal and fill-in-middle against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadglass.llm import passage_dedup as passages, source_audit as audit
from roadglass.llm.fill_middle import fill_in_middle, fill_middle_pieces, restore_middle, restored, split, token_ends, walked
from roadglass.llm.fm_index import FMIndex, code_lengths
from roadglass.llm.passage_dedup import WINDOW, least_documents, passage_dedup, word_blocks
from roadglass.llm.source_audit import source_divergence, term_counts

SCHEMA = "doc_id long, text string, lang string, source string, place int, gram string, n string, form string, term string, total string"


def table(spark, rows):
    """(id, text[, lang, source]) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, *[None] * (4 - len(r)), 1, "g", "n", "f", "t", "x") for r in rows], SCHEMA).repartition(3)


# --- FM-index


@pytest.mark.parametrize("n, letters", [(1, 1), (30, 1), (200, 3), (500, 6), (400, 40)])
def test_matching_statistics(n, letters):
    rng = np.random.default_rng(n)
    text = np.append(rng.integers(0, letters + 1, n), 0)
    index = FMIndex(text, 5)
    strings = Counter(tuple(text[i : i + k].tolist()) for k in range(1, 6) for i in range(len(text) - k + 1))
    query = rng.integers(1, letters + 3, 300)
    sizes = np.array([0, 1, 50, 49, 100, 100])
    starts = np.cumsum(sizes) - sizes
    length, low, high = index.matching_statistics(query, starts, sizes)
    for a, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        for i in range(a, a + size):
            best = max(k for k in range(6) if i + k <= a + size and (k == 0 or tuple(query[i : i + k].tolist()) in strings and 0 not in query[i : i + k]))
            assert length[i] == best
            if best:
                want = tuple(query[i : i + best].tolist())
                assert high[i] - low[i] == strings[want]
                assert all(tuple(text[p : p + best].tolist()) == want for p in index.order[low[i] : high[i]])


def test_wavelet_tree_is_no_larger_than_its_entropy_asks():
    rng = np.random.default_rng(0)
    symbols = np.minimum(rng.zipf(1.5, 20_000), 500)
    counts = np.bincount(symbols)
    share = counts[counts > 0] / counts.sum()
    bits = (code_lengths(counts) * counts).sum() / counts.sum()
    assert -(share * np.log2(share)).sum() <= bits < -(share * np.log2(share)).sum() + 1
    tree = FMIndex(np.append(symbols, 0), 4).tree
    stored = sum(b.words.nbytes for b, _, _ in tree.levels) * 8
    assert stored < 1.05 * bits * len(symbols) + 200 * len(tree.levels)


# --- passages


def brute_passages(rows):
    least, out = {}, []
    docs = [(-(1 << 63) if i is None else i, (t or "").encode().split()) for i, t in rows]
    for i, w in docs:
        for k in range(len(w) - WINDOW + 1):
            key = tuple(w[k : k + WINDOW])
            least[key] = min(least.get(key, i), i)
    for (i, w), (doc_id, _) in zip(docs, rows, strict=True):
        gone = bytearray(len(w))
        for k in range(len(w) - WINDOW + 1):
            if least[tuple(w[k : k + WINDOW])] < i:
                gone[k : k + WINDOW] = b"\1" * WINDOW
        out.append((doc_id, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=str)


def tangled():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60)))) for i in range(120)]
    rows += [(None, "x " * 40), (7, None), (8, ""), (8, " \t\n"), (9, "x " * 30), (9, "x " * 30), (9, "y\t\n" * 20), (10, "y " * 20), (-5, "ä\x0bß " * 30), (11, "ä\x0bß\n" * 30), (12, "Ä\x0bß\n" * 30)]
    long = " ".join(rng.choice(["road", "car", "toll", "lorry", " ", "bridge "]) for _ in range(30_000))
    return rows + [(400, long), (401, "own words " + long[2_000:90_000]), (402, long), (403, long.upper())]


@pytest.mark.parametrize("crowded", [10_000, 2])
def test_passages(spark, crowded):
    rows = tangled()
    got = sorted(map(tuple, passage_dedup(table(spark, rows), crowded=crowded).collect()), key=str)
    want = brute_passages(rows)
    assert got == want and sum(x[2] for x in want) > 40_000


def test_a_passage_that_most_documents_hold(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"start {k} of {k * 7} {passage} end {k * 3} there {k}") for k in range(900)]
    got = sorted(map(tuple, passage_dedup(table(spark, rows), crowded=50).collect()), key=str)
    assert got == brute_passages(rows) and sum(x[2] for x in got) >= 899 * 60


def test_passages_of_no_documents_and_of_ids_without_an_order(spark):
    assert passage_dedup(table(spark, [])).count() == 0
    with pytest.raises(TypeError, match="whole numbers"):
        passage_dedup(table(spark, []), id_col="lang")


def test_blocks_of_a_long_text_share_their_windows():
    rng = random.Random(1)
    words = [rng.choice(["a", "bc", "déf"]).encode() for _ in range(2_000)]
    text = b" \n ".join(words).decode()
    for block in (1, 7, 100, 1 << 20):
        seen = {}
        for place, part in word_blocks(text, block):
            for k in range(len(part) - WINDOW + 1):
                assert place + k not in seen
                seen[place + k] = part[k : k + WINDOW]
        assert seen == {k: words[k : k + WINDOW] for k in range(len(words) - WINDOW + 1)}


def test_least_documents_of_a_shard():
    rng = random.Random(2)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(13, 22))).encode() for _ in range(400)]
    ids = np.array([rng.randrange(1000) for _ in parts])
    import pyarrow as pa

    least = defaultdict(lambda: 10_000)
    windows = [[tuple(p.split()[k : k + WINDOW]) for k in range(len(p.split()) - WINDOW + 1)] for p in parts]
    for i, ws in zip(ids.tolist(), windows, strict=True):
        for w in ws:
            least[w] = min(least[w], i)
    assert least_documents(pa.array(parts, pa.binary()), ids).to_pylist() == [[least[w] for w in ws] for ws in windows]


def test_shards_end_between_grams(monkeypatch):
    monkeypatch.setattr(passages, "CHUNK", 20)
    import pyarrow as pa

    parts = [f"k{k % 5} ".encode() * 14 + b"end" for k in range(60)]
    keys = sorted(k // 3 for k in range(60))
    batches = [pa.RecordBatch.from_pydict({"key": keys[a : a + 7], "gram": keys[a : a + 7], "digest": list(range(a, min(a + 7, 60))), "least": list(range(a, min(a + 7, 60))), "data": parts[a : a + 7]}) for a in range(0, 60, 7)]
    out = list(passages._searched(iter(batches)))
    assert len(out) > 5 and sum(b.num_rows for b in out) == 60
    held = [set(b.column("gram").to_pylist()) for b in out]
    assert sum(map(len, held)) == len(set.union(*held))


# --- fill-in-middle


def brute_fill(doc_id, text):
    text = text or ""
    tokens = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(tokens)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(tokens[:lo]), "".join(tokens[lo:hi]), "".join(tokens[hi:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return doc_id, n, "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def fill_rows():
    rng = random.Random(4)
    bits = ["word", " ", "\n", "\t ", "Été", " ", "<", "P>", "<S", "日本", "\x0b", "\x1c", "x"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 40)))) for k in range(400)]
    rows += [(None, "a b c"), (None, None), (900, None), (901, ""), (902, " \n"), (903, "a <M> b"), (904, "<"), (905, "car " * 200_000), (906, "x" * 100_000), (907, "twice same"), (907, "twice same"), (907, "other text here")]
    return rows


def test_fill_in_middle(spark):
    rows = fill_rows()
    made = fill_in_middle(table(spark, rows))
    got = made.collect()
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert sorted((tuple(r[c] for c in columns) for r in got), key=str) == sorted((brute_fill(*r) for r in rows), key=str)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert all(r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() for r in got)
    back = restore_middle(made).collect()
    assert Counter((r["doc_id"], r["restored"]) for r in back) == Counter((i, t or "") for i, t in rows)
    assert all(r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest() for r in back)


def test_shares_of_the_forms_follow_the_rates(spark):
    rows = [(k, f"some words of text {k}") for k in range(2_000)]
    forms = Counter(r["form"] for r in fill_in_middle(table(spark, rows), rate=90, spm_rate=25).collect())
    assert abs(forms["plain"] - 200) < 60 and abs(forms["spm"] - 450) < 90
    assert fill_in_middle(table(spark, [])).count() == 0 and restore_middle(fill_in_middle(table(spark, []))).count() == 0


def test_piece_tables_are_cut_anywhere():
    data = bytes(range(100))
    pieces = [(0, 0, 40), (0, 40, 40), (0, 40, 100)]
    for at in range(101):
        parts = split(pieces, at)
        assert b"".join(walked(parts, data)) == data and at in np.cumsum([0] + [b - a for _, a, b in parts])
    n, form, made = fill_middle_pieces(b"one two three four", 5, "42", 100, 50)
    output = b"".join(walked(made, b"one two three four"))
    assert n == 4 and b"".join(walked(restored(output, form), output)) == b"one two three four"
    assert token_ends(b" a  b ").tolist() == [2, 5, 6] and token_ends(b"").tolist() == []


# --- source audit


def brute_audit(rows, min_docs=3, top=200):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= min_docs)
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if held[t] >= min_docs)
        every = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values()) + len(kept)  # noqa: B023
            return {t: 1 + 10**9 * (c[t] + 1) // total for t in kept}  # noqa: B023

        p, q = {s: shares(c) for s, c in counts.items()}, shares(every)
        for s in counts:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in counts if o != s]
            terms = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit_rows():
    rng = random.Random(6)
    vocabulary = [x * k for k in range(1, 8) for x in ("a", "Bc", "é", "日本", "straße")] + ["q" * 8, "q" * 9, "q" * 16, "q" * 17, "z" * 40, "aa", "ab", "Ab"]
    rows = []
    for k in range(240):
        own = vocabulary[k % 5 :: 5] * 2 + vocabulary
        rows.append((k, rng.choice([" ", "-", "1"]).join(rng.choice(own) for _ in range(rng.randrange(0, 80))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "S3", "é", None])))
    rows += [(300, None, "en", "empty source"), (301, "", "it", "a"), (302, "one two", "it", "b"), (303, "1 2 3", "xx", "alone"), (None, "q " * 40_000 + "r" * 70_000, "en", "s1"), (304, "same row", "fr", "s1"), (304, "same row", "fr", "s1"), (305, "same", "fr", "s2")]
    return rows


def test_source_audit(spark):
    rows = audit_rows()
    got = sorted(tuple(r) for r in source_divergence(table(spark, rows)).collect())
    assert got == brute_audit(rows)
    assert any(r[0] == "it" and r[2] == "pair" and r[4] == 0 for r in got) and not any(r[0] == "xx" for r in got)


def test_source_audit_in_small_blocks_tiles_and_few_ranks(spark, monkeypatch):
    rows = audit_rows()
    for name, value in (("TERMS", 7), ("SIDE", 2), ("BLOCK", 500)):
        monkeypatch.setattr(audit, name, value)
    assert sorted(tuple(r) for r in source_divergence(table(spark, rows), min_docs=2, top=3).collect()) == brute_audit(rows, 2, 3)


def test_term_counts(spark):
    rows = audit_rows()
    got = {tuple(r) for r in term_counts(table(spark, rows)).collect()}
    docs, n = Counter(), Counter()
    for _, t, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        n.update((lang or "", source or "", x) for x in found)
        docs.update((lang or "", source or "", x) for x in set(found))
    assert got == {(*k, docs[k], v) for k, v in n.items()}
    assert source_divergence(table(spark, [])).count() == 0


def test_shares_do_not_overflow(spark):
    n, total = 7 * 10**14 + 3, 9 * 10**14 + 1
    want = 1 + 10**9 * (n + 1) // total
    assert audit.shares(np.array([n]), np.array([total])).tolist() == [want]
    df = spark.createDataFrame([(n, total)], "n long, total long")
    assert df.select(F.expr(audit._share("n", "total"))).first()[0] == want
