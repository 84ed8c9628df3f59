"""Operators 2 and 9: against the tokenizers library, and exact round trips."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import queries as Q
from quern.llm.arrow_output import read_token_files, sequence, write_token_files
from quern.llm.bpe import bpe_encode_decode, codec

from .conftest import TEXTS

PATH = Q.tokenizer_file()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    c = codec(PATH)
    want = c.library.encode(text, add_special_tokens=False).ids
    assert c.encode(text).tolist() == want
    assert c.decode(c.encode(text)) == c.library.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["don't", "<|endoftext|>", "x<|startoftext|>y", "été", "ß", "A1b2", "''s", "re", " ", "\n", "qzx" * 40, "漢字", " ", "İ", "Σ", "\x1c"]), max_size=12))
def test_odd_pieces(parts):
    c = codec(PATH)
    text = "".join(parts)
    assert c.encode(text).tolist() == c.library.encode(text, add_special_tokens=False).ids


def test_cuts_are_forced():
    """No token of the vocabulary holds the pair at a cut."""
    c = codec(PATH)
    got = c.fragments_of("qzxjqvwkß" * 3)
    assert "".join(got).encode() and len(got) > 1


def test_cache_starts_anew(monkeypatch):
    import quern.llm.bpe as B

    monkeypatch.setattr(B, "CACHE_WORDS", 5)
    c = B.ForcedBoundaryCodec(PATH)
    for t in [t or "" for _, t in TEXTS] * 2:
        assert c.encode(t).tolist() == c.library.encode(t, add_special_tokens=False).ids


def test_table(docs, clashing, empty, library):
    for df in (docs, clashing):
        rows = bpe_encode_decode(df, PATH).collect()
        assert len(rows) == len(TEXTS)
        want = sorted((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in TEXTS)
        assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert bpe_encode_decode(empty, PATH).count() == 0


def expected_files(library, rows):
    out, start = [], 0
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("length", [16, 2048])
def test_files(spark, library, tmp_path, length):
    from .conftest import table

    rows = [(k, t) for k, (_, t) in enumerate(TEXTS)]
    files = write_token_files(table(spark, rows), f"file://{tmp_path}/f", PATH, 2, length, n_files=3)
    got = read_token_files(spark, files).selectExpr("doc_id", "start", "n_tokens", "crc32(ids) c").collect()
    assert sorted(map(tuple, got)) == expected_files(library, rows)
    ids, masked = [], 0
    for f in files.files:
        for k in range(f["n_sequences"]):
            tokens, mask = sequence(f"{tmp_path}/f/{f['name']}.arrows", k)
            assert len(tokens) == len(mask) == length
            ids += tokens[mask].tolist()
            masked += int((~mask).sum())
        with pytest.raises((IndexError, Exception)):
            sequence(f"{tmp_path}/f/{f['name']}.arrows", f["n_sequences"] + 64)
    assert hashlib.sha256(str(ids).encode()).digest() == hashlib.sha256(str([x for _, t in rows for x in [*library.encode(t or "", add_special_tokens=False).ids, 2]]).encode()).digest()


def test_repeats_and_nulls(spark, docs, clashing, empty, tmp_path):
    for name, df in (("a", docs), ("b", clashing)):
        files = write_token_files(df, f"file://{tmp_path}/{name}", PATH, 2, 64, n_files=2)
        got = read_token_files(spark, files).orderBy("start").collect()
        assert len(got) == len(TEXTS)
        ids = [r.doc_id for r in got]
        assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
        assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    files = write_token_files(empty, f"file://{tmp_path}/c", PATH, 2)
    assert files.files == [] and read_token_files(spark, files).count() == 0
