"""Operators 3, 4, 7 and 8 against brute force."""

import collections
import hashlib
import re
import unicodedata

import numpy as np
import pytest
import xxhash

from quern.llm import simhash as S
from quern.llm.components import connected_components
from quern.llm.decontaminate import contamination
from quern.llm.digest import edited_digests, exact_classes
from quern.llm.line_dedup import LONG_CHARS, WINDOW, line_dedup
from quern.llm.shared import written

from .conftest import BASE, TEXTS, sentence, table


def folded(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def test_edited_digests(spark):
    rows = [(k * 3 + 1, t) for k, (_, t) in enumerate(TEXTS)]
    got = {r.doc_id: r for r in edited_digests(table(spark, rows), n_parts=3).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.near_edited, r.near_next) == (float(folded(edited) == folded(t)), float(folded(nxt) == folded(t)))


def test_digest_cases(spark, docs, clashing, empty):
    for df in (docs, clashing):
        assert edited_digests(df).count() == len(TEXTS)
    assert edited_digests(empty).count() == 0
    one = edited_digests(table(spark, [(5, "abcd")])).first()
    assert one.near_next == 1.0 and one.n_chars == 4


def test_exact_classes(spark):
    rows = [(k, t) for k, (_, t) in enumerate(TEXTS)]
    df = table(spark, rows)
    prints = written(edited_digests(df).select("doc_id", "fingerprint", "tie"))
    got = {r.doc_id: (r.class_id, r.n_copies) for r in exact_classes(df, prints).collect()}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    assert got == {i: (min(g), len(g)) for g in groups.values() for i in g}


def test_collision_is_told_apart(spark, monkeypatch):
    """Two texts with one fingerprint stay two classes."""
    import quern.llm.digest as D

    df = table(spark, [(1, "a"), (2, "b"), (3, "a"), (4, "c c"), (5, "b")])
    real = D.exact_digests
    from pyspark.sql import functions as F

    print_of = F.when(F.col("doc_id") == 4, "y").otherwise("x")
    prints = df.select("doc_id", print_of.alias("fingerprint"), D.tie_of(F.col("text")).alias("tie"))
    monkeypatch.setattr(D, "exact_digests", lambda *a, **k: real(*a, **k).withColumn("fingerprint", F.when(F.col("canonical") == "c c", "y").otherwise("x")))
    got = {r.doc_id: (r.class_id, r.n_copies) for r in D.exact_classes(df, prints).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2), 4: (4, 1)}


def test_repeated_and_null_ids(spark):
    """One row for each row, whatever repeats; null ids count as copies and name no class."""
    rows = [(1, "A b"), (1, "a  b"), (1, "other"), (2, "A B"), (None, "a b"), (None, "only"), (None, "only"), (3, None)]
    df = table(spark, rows)
    prints = written(edited_digests(df))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.class_id), r.n_copies) for r in exact_classes(df, prints).collect())
    digest = lambda t: xxhash.xxh3_128_hexdigest(folded(t).encode())
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    want = [(str(i), digest(t), str(min((x for x in groups[folded(t)] if x is not None), default=None)), len(groups[folded(t)])) for i, t in rows]
    assert got == sorted(want)


def brute_print(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)) if h else 0


def brute_components(prints, ids, threshold):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fp = np.array(prints, np.uint64)
    for i in range(len(fp)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= threshold):
            parent[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fp))]


def test_simhash_table(spark, docs, clashing, empty):
    for df in (docs, clashing):
        got = sorted((str(r.doc_id), r.fp % 2**64, str(r.component_id)) for r in S.simhash_classes(df).collect())
        prints = [brute_print(t, 4) for _, t in TEXTS]
        comp = brute_components(prints, [i for i, _ in TEXTS], 4)
        assert got == sorted((str(i), p, str(c)) for (i, _), p, c in zip(TEXTS, prints, comp, strict=True))
    assert S.simhash_classes(empty).count() == 0


@pytest.mark.parametrize("parts,threshold", [(S.HALVES, 4), (S.HALVES, 3), (S.THIRDS, 11), (S.EXACT_HALVES, 4), (S.HAMMING_HALVES, 4), (None, 4)])
def test_no_link_is_missed(spark, parts, threshold, monkeypatch):
    """Chains and crowds of fingerprints; crowded anchors are dealt to several tasks."""
    monkeypatch.setattr(S, "RESIDENTS", 8)
    rng = np.random.default_rng(threshold)
    prints = rng.integers(0, 1 << 64, 60, dtype=np.uint64).tolist()
    for k in range(140):
        x = prints[rng.integers(len(prints))]
        for b in rng.choice(64, rng.integers(1, threshold + 2), replace=False):
            x ^= 1 << int(b)
        prints.append(x)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    roots = {r.node: r.root for r in connected_components(S.simhash_links(df, threshold, parts)).collect()}
    label = [roots.get(p, p) for p in signed]
    want = brute_components(prints, list(range(len(prints))), threshold)
    groups = lambda xs: {frozenset(i for i, y in enumerate(xs) if y == x) for x in xs}
    assert groups(label) == groups(want)


def test_crowded_anchor_is_streamed(spark, monkeypatch):
    """An anchor with far more rows than a task gathers meets its visitors in turn."""
    monkeypatch.setattr(S, "RESIDENTS", 40)
    monkeypatch.setattr(S, "HELD", 50)
    rng = np.random.default_rng(3)
    prints = [0]
    for _ in range(400):  # all near the anchor zero
        x = prints[int(rng.integers(len(prints)))]
        for b in rng.choice(64, 3, replace=False):
            x ^= 1 << int(b)
        prints.append(x if x.bit_count() < 9 else 1 << int(rng.integers(64)))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame(list(enumerate(signed)), "doc_id long, fp long")
    roots = {r.node: r.root for r in connected_components(S.simhash_links(df, 4)).collect()}
    label, want = [roots.get(p, p) for p in signed], brute_components(prints, list(range(len(prints))), 4)
    groups = lambda xs: {frozenset(i for i, y in enumerate(xs) if y == x) for x in xs}
    assert groups(label) == groups(want)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 100), (200, 201), (201, 200), (5, 300)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 300: 0, 200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_hits(docs, items, window=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(len(w), window)
        for k in range(len(w) - n + 1 if w else 0):
            grams[tuple(w[k : k + n])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if ids := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((str(d), len(w), len(hit), sorted(map(str, found))))
    return sorted(out)


def test_contamination(spark, docs, clashing, empty):
    items = [(1, BASE[:120]), (2, "one"), (3, None), (4, ""), (5, "İstanbul ÉTÉ K1 the Été"), (6, sentence(5, 24)), (6, "naïve 漢字"), (7, "zz yy")]
    extra = [*TEXTS, (21, "x1 " * 5 + BASE.upper() + " ONE ... one,one"), (22, "İstanbul ÉTÉ k1 THE Été i̇stanbul"), (23, "été k1"), (24, "...one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for df in (table(spark, extra), table(spark, extra).withColumn("item_id", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(3))):
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in contamination(df, bench).collect())
        assert got == brute_hits(extra, items)
    assert contamination(empty, bench).count() == 0
    none = contamination(docs, bench.limit(0)).collect()
    assert len(none) == len(TEXTS) and all(r.n_hit == 0 for r in none)


def test_proximity(spark):
    w = sentence(3, 10).replace(".", "").split()
    df = table(spark, [(1, " ".join(w[::-1])), (2, " ".join(w))])
    got = {r.doc_id: (r["items"], r["near_items"]) for r in contamination(df, spark.createDataFrame([(9, " ".join(w))], "item_id long, text string")).collect()}
    assert got == {1: ([], [9]), 2: ([9], [9])}


def test_case_folds_ascii_only(spark):
    """A capital sigma is the same word wherever it stands, and another one than a small sigma."""
    items = [(1, "\u0391\u03a3.\u0392\u0393"), (2, "\u0391\u03a3 XY"), (3, "\u03b1\u03c3 xy")]
    rows = [(1, items[0][1]), (2, "\u039f.\u0391\u03a3'xy"), (3, "\u03b1\u03c3 XY"), (4, "\u03b1\u03c2 xy")]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == brute_hits(rows, items) and [x[2] for x in got] == [2, 2, 2, 0]


def test_very_many_hits(spark):
    """A hundred thousand hits in one text, some over the edges of blocks."""
    rows = [(1, "common " * 100_000 + "the end"), (2, "a b c d e f g h i j k l " * 200)]
    items = [(1, "common"), (2, "j k l a b c d e f g h i"), (3, "the")]
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, sorted(map(str, r["items"]))) for r in contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [("1", 100_002, 100_001, ["1", "3"]), ("2", 2400, 2388, ["2"])]


def brute_lines(rows):
    cut = re.compile(r"(?<=[.!?][ \t])(?=\S)|(?<=\n)(?=\S)")

    def lines(t):
        at = [0, *(m.start() for m in cut.finditer(t) if m.start()), len(t)]
        return [t[a:b] for a, b in zip(at, at[1:], strict=False)] if t else [""]

    def number(s):
        v = xxhash.xxh64_intdigest(s.strip(" \t\r\n").encode(), seed=42)
        v -= (v >> 63) << 64
        return (v & -2) + (len(s) >= LONG_CHARS)

    def signed(x):
        return x - 2**64 if x >> 63 else x

    docs = {}
    for i, t in rows:
        if t is not None:
            key = (2**63 - 1 if i is None else i, signed(xxhash.xxh64_intdigest(t.encode(), seed=42)))
            docs[key] = lines(t)
    nums = {k: [number(x) for x in v] for k, v in docs.items()}
    prints = collections.defaultdict(list)
    for k, h in nums.items():
        pick = {p for p, x in enumerate(docs[k]) if len(x) >= LONG_CHARS}
        if len(h) < WINDOW:
            pick |= {p for p, x in enumerate(h) if x == min(h)}
        for s in range(len(h) - WINDOW + 1):
            w = h[s : s + WINDOW]
            pick.add(s + max(j for j in range(WINDOW) if w[j] == min(w)))
        for p in pick:
            prints[h[p]].append((*k, p))
    spans = collections.defaultdict(set)
    for places in prints.values():
        places.sort()
        *f, at = places[0]
        a = nums[tuple(f)]
        for *k, p in places[1:]:
            b = nums[tuple(k)]
            back = on = 0
            while back < WINDOW and p > back and at > back and b[p - back - 1] == a[at - back - 1]:
                back += 1
            while on < WINDOW and p + on + 1 < len(b) and at + on + 1 < len(a) and b[p + on + 1] == a[at + on + 1]:
                on += 1
            spans[tuple(k)].add((p - back, p + on + 1))
    out = []
    for i, t in rows:
        if t is None:
            out.append((str(i), None, 0, 0))
            continue
        key = (2**63 - 1 if i is None else i, signed(xxhash.xxh64_intdigest(t.encode(), seed=42)))
        own, runs = docs[key], []
        for a, b in sorted(spans.get(key, ())):
            if runs and runs[-1][1] >= a:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        gone = {p for a, b in runs if b - a >= WINDOW or any(len(x) >= LONG_CHARS for x in own[a:b]) for p in range(a, b)}
        out.append((str(i), "".join(x for p, x in enumerate(own) if p not in gone), len(own), len(gone)))
    return sorted(out, key=repr)


def test_line_dedup(spark, clashing, empty):
    passage = sentence(77, 60)
    rows = [*TEXTS, (30, sentence(31) + " " + passage + "\nEnd."), (31, passage + "\n" + sentence(32)), (32, "a. b. c. " * 9), (33, "mark \x01 one. two. " + passage), (34, "Short. Line."), (35, "Short. Line."), (36, "  \n\n x. \n\n y.  z")]
    got = sorted(((str(r.doc_id), r.text, r.n_lines, r.n_removed) for r in line_dedup(table(spark, rows)).collect()), key=repr)
    assert got == brute_lines(rows)
    texts = [t for _, t, _, _ in got if t]
    assert sum(passage[:200] in t for t in texts) == 1
    assert line_dedup(empty).count() == 0
    out = line_dedup(clashing)
    assert out.count() == len(TEXTS) and {r.fp for r in out.collect()} == {"own"}


def every_repeat(rows):
    """Each line that lies in a run that stands earlier and has WINDOW lines or a long one, by trying all pieces of lines."""
    cut = re.compile(r"(?<=[.!?][ \t])(?=\S)|(?<=\n)(?=\S)")
    held = [(i, [t[a:b] for a, b in zip(at, at[1:], strict=False)]) for i, t in rows for at in [[0, *(m.start() for m in cut.finditer(t) if m.start()), len(t)]]]
    seen, gone = {}, collections.defaultdict(set)
    for i, lines in sorted(held):
        for a in range(len(lines)):
            for k in range(1, WINDOW + 1):
                piece = [(x.strip(" \t\r\n"), len(x) >= LONG_CHARS) for x in lines[a : a + k]]
                if len(piece) == k and (k == WINDOW or any(long for _, long in piece)) and seen.setdefault(tuple(piece), (i, a)) != (i, a):
                    gone[i] |= set(range(a, a + k))
    return sorted((i, "".join(x for p, x in enumerate(lines) if p not in gone[i]), len(gone[i])) for i, lines in held)


def test_lines_that_stand_elsewhere_first(spark):
    """Passages whose single lines all stand earlier among other lines, and texts drawn from few lines."""
    rng = np.random.default_rng(7)
    lines = [f"Line {k} of few." for k in range(14)] + [f"Long {k} " + "x" * LONG_CHARS + "." for k in range(4)]
    passage = lines[:6]
    rows = [(1, "\n".join(f"Only {k}.\n{x}" for k, x in enumerate(passage))), (2, "\n".join(["Second.", *passage])), (3, "\n".join([*passage, "Third."])), (4, "\n".join([f"A.\n{lines[14]}\nB."])), (5, f"Five.\n{lines[6]}\n{lines[14]}"), (6, f"Six.\n{lines[6]}\n{lines[14]}\n{lines[7]}")]
    rows += [(10 + d, "\n".join(lines[int(k)] for k in rng.integers(0, len(lines), int(rng.integers(1, 60))))) for d in range(60)]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in line_dedup(table(spark, rows)).collect())
    assert got == every_repeat(rows)
    assert got[2][1] == "Third." and got[5][1] == f"Six.\n{lines[7]}"
