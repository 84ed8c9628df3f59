"""The pipeline's stages by their decisions, and its run on a small table."""

import collections
import hashlib
import re
import zlib

import corpus_pipeline as C
from quern.llm.language_id import PROFILE, UNKNOWN
from quern.llm.queries import tokenizer_file

from .conftest import SCHEMA, sentence
from .test_duplicates import brute_hits, every_repeat
from .test_models import plain_counts
from .test_near_copies import brute_classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    """Planted cases on top of the driver's smallest table: junk goes, copies leave one, passages and leaks go."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    base, words = sentence(501, 120), sentence(601, 400).split()
    near = words[:200] + ["changed"] + words[201:]
    planted = [
        (9001, "12 34 !!", None, "x", 8),
        (9002, None, "en", "x", None),
        (9003, base, None, "x", len(base)),
        (9004, base, "en", "x", len(base)),
        (9005, " ".join(words).replace(".", ""), "en", "x", 1),
        (9006, " ".join(near).replace(".", ""), "en", "x", 1),
        (9007, sentence(701, 30) + "\n" + item, "en", "x", 1),
        (9008, sentence(801, 90), "en", "x", 1),
    ]
    out = docs.unionByName(spark.createDataFrame(planted, SCHEMA))
    kept = []
    for _, stage in C.STAGES:
        before = out
        out = C.written(stage(spark, out, SF))
        if stage is not C.encode:
            assert out.columns == before.columns
            kept.append({r.doc_id: r for r in out.where("doc_id >= 9001").collect()})
    lang, lines, near_, clean = kept
    assert set(lang) == set(range(9003, 9009)) and lang[9003].lang not in (None, UNKNOWN)
    assert lines[9003].text == base and lines[9004].text == "" and lines[9004].n_chars == 0
    assert 9005 in near_ and 9006 not in near_ and 9008 in near_
    assert 9007 not in clean and {9003, 9005, 9008} <= set(clean)
    assert out.where("doc_id = 9008").first().n_tokens > 90
    total = docs.count()
    assert out.count() > 0.8 * total


def test_empty_and_odd(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word", "en", "a", 4)]
    for data in ([], rows):
        out = spark.createDataFrame(data, SCHEMA)
        for _, stage in C.STAGES:
            out = C.written(stage(spark, out, SF))
        assert out.count() <= len(data)


def ranked(counts):
    """N-grams by count, then by length and code points; the first PROFILE of them, with their places."""
    return {g: k for k, g in enumerate(sorted(counts, key=lambda g: (-counts[g], len(g), g))[:PROFILE])}


def plain_languages(rows):
    """The first stage in plain Python: rows (id, text, lang, source) that stay, with their language."""
    learned = collections.defaultdict(collections.Counter)
    for i, t, lang, _ in rows:
        if lang is not None and t is not None and (i is None or zlib.crc32(str(i).encode()) % 3 != 1):
            learned[lang].update(plain_counts(t))
    profiles = {k: ranked(c) for k, c in sorted(learned.items())}
    out = []
    for i, t, lang, source in rows:
        mine = ranked(plain_counts(t or ""))
        if mine:
            apart = {k: sum(abs(place - p[g]) if g in p else PROFILE for g, place in mine.items()) for k, p in profiles.items()}
            best = min(apart, key=lambda k: (apart[k], k))
            if 1 - apart[best] / (PROFILE * len(mine)) >= C.LEAST_SCORE:
                out.append((i, t, lang if lang is not None else best, source))
    return out


def test_run_against_plain_python(spark, tmp_path):
    """All five stages over the driver's smallest table and a few odd rows, against the same stages in plain Python."""
    from tokenizers import Tokenizer

    base = sentence(501, 120)
    odd = [(9001, "12 34 !!", None, "x", 8), (9002, None, "en", "x", None), (9003, base, None, "x", 1), (9004, base, "en", "x", 1), (9005, base + " more", "en", "x", 1)]
    spark.read.parquet(f"{SF}/documents.parquet").unionByName(spark.createDataFrame(odd, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert len({i for i, *_ in docs}) == len(docs)
    kept = plain_languages(docs)
    cut = {i: t for i, t, _ in every_repeat([(i, t) for i, t, *_ in kept])}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for i, t in cut.items()}
    ids = sorted(cut)
    label = brute_classes([{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (words[i] for i in ids)], 0.8)
    first = {min(ids[k] for k in range(len(ids)) if label[k] == x) for x in set(label)}
    hit = {i for i, _, n, _ in brute_hits([(i, cut[i]) for i in first], items) if n}
    library = Tokenizer.from_file(tokenizer_file())
    library.no_truncation()
    library.no_padding()
    want = []
    for i, _, lang, source in kept:
        if i in first and str(i) not in hit:
            tokens = library.encode(cut[i], add_special_tokens=False).ids
            want.append((i, lang, source, tokens, len(tokens), hashlib.sha256(library.decode(tokens, skip_special_tokens=False).encode()).hexdigest()))
    got = sorted((r.doc_id, r.lang, r.source, list(r.ids), r.n_tokens, r.decoded_sha256) for r in C.run(spark, str(tmp_path)).collect())
    assert len(kept) < len(docs) and len(first) < len(kept) and hit and len(got) > 100
    assert got == sorted(want)
