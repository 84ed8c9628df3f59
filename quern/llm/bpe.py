"""Operator 2: BPE encoding and decoding with forced boundaries.

A merge can only join two neighbouring symbols if their pair occurs inside some token of the
vocabulary. Every neighbouring pair that occurs in none is therefore a certain cut: the fragments
between cuts are encoded independently and concatenated, with the same ids as the whole word.

Words repeat much, so a bounded cache keeps their ids, and the words of a step are looked up together. Those that are new
are cut at their forced boundaries and all their fragments go through the merge loop side by side, as the rows of an
array: each round joins the lowest-ranked pair of every fragment.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import released, steps, texts_of

#: Entries after which the cache of words starts anew.
CACHE_WORDS = 700_000
#: Symbols up to which fragments go through the vectorised merge loop; the library takes longer ones.
SHORT = 64
#: Letters below this code point have had the same category in all versions of Unicode that matter.
STABLE = 0x250
#: First of the private code points that stand for "this byte, at the end of a word".
PRIVATE = 0xE000
#: What the pre-tokenizer of the supported files does to code points below STABLE (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_alphabet() -> list[str]:
    """The printable character for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the others follow from 256 on."""
    keeps = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    moved = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(keeps))}
    return [moved.get(b, chr(b)) for b in range(256)]


#: By code point below STABLE: whether _split_plain finds the words around it, so no control character, white space or apostrophe.
PLAIN = np.array([bool(regex.fullmatch(r"[!-&(-~\xa1-\u012f\u0131-\u0239]", chr(c))) for c in range(STABLE)])
#: By code point: 0 space, 1 letter, 2 number, 3 other. Lower case of plain characters stays in this range.
KINDS = np.array([0 if c == " " else 1 if c.isalpha() else 2 if regex.match(r"\p{N}", c) else 3 for c in map(chr, range(0x300))], np.uint8)


#: By number of bytes from 0 to 8: the bits that they take up in a little-endian number.
MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class ForcedBoundaryCodec:
    """Encoder and decoder for a byte-level BPE file of the ``tokenizers`` library.

    ``encode`` equals the library's ids with ``add_special_tokens=False``, no truncation or padding;
    strings of added tokens in a text become their ids, as in the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("dropout"):
            raise ValueError("a plain byte-level BPE file is needed")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        self._last = {c: chr(PRIVATE + i) for i, c in enumerate(self.alphabet)} if self.suffix else {c: c for c in self.alphabet}
        vocab = {self._spelled(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        merges = [(self._spelled(a), self._spelled(b)) for a, b in pairs]
        # A symbol is a byte, or 256 + a byte that ends a word.
        symbol = {c: b for b, c in enumerate(self.alphabet)}
        if self.suffix:
            symbol |= {chr(PRIVATE + b): 256 + b for b in range(256)}
        self._mark = 256 if self.suffix else 0
        self.joins = np.zeros((512, 512), bool)
        for t in vocab:
            for x, y in zip(t, t[1:], strict=False):
                if x in symbol and y in symbol:
                    self.joins[symbol[x], symbol[y]] = True
        self._first = np.full(512, -1, np.int64)
        for c, i in symbol.items():
            self._first[i] = vocab.get(c, -1)
        if (self._first[:256] < 0).any():
            raise ValueError("a vocabulary with all 256 bytes is needed")
        keyed = {}
        for rank, (x, y) in enumerate(merges):
            keyed.setdefault(vocab[x] << 32 | vocab[y], (rank, vocab[x + y]))
        self._keys = np.array(sorted(keyed), np.int64)
        self._rank, self._made = np.array([keyed[k] for k in self._keys.tolist()], np.int64).T.copy() if keyed else np.zeros((2, 0), np.int64)
        self._slots()
        self.fragments = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.tokens = [""] * size
        for t, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.tokens[i] = t
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
        self._added = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        self.decoder = (spec.get("decoder") or {}).get("type")
        steps_ = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self._pattern = regex.compile(WORD_PATTERN)
        drops_space = bool(steps_) and steps_[0].get("pattern", {}).get("Regex") == WORD_PATTERN and steps_[0]["behavior"] == "Removed"
        if not (drops_space and plain):
            raise ValueError("a file whose pre-tokenizer drops white space is needed")
        self._seed()

    def _seed(self) -> None:
        """An empty cache: the ids of known chunks in one array, where each begins and how many it has, and the chunks' numbers."""
        self._ids, self._n_ids = np.empty(1 << 16, self.dtype), 0
        self._begin, self._count, self._n_known = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64), 0
        self._short: dict[int, int] = {}
        self._long: dict[bytes, int] = {}
        for t, i in self.added.items():
            raw, number = t.encode("utf-8"), self._keep(np.asarray([i], self.dtype), np.array([1]))
            self._long[raw] = number
            if len(raw) <= 8:
                self._short[int.from_bytes(raw, "little")] = number

    def _keep(self, ids: np.ndarray, counts: np.ndarray) -> int:
        """Put the ids of new chunks into the cache; the number of the first one."""
        for name, used, more in (("_ids", self._n_ids, len(ids)), ("_begin", self._n_known, len(counts)), ("_count", self._n_known, len(counts))):
            held = getattr(self, name)
            if used + more > len(held):
                setattr(self, name, np.concatenate([held, np.empty(max(len(held), more), held.dtype)]))
        first = self._n_known
        self._ids[self._n_ids : self._n_ids + len(ids)] = ids
        self._count[first : first + len(counts)] = counts
        self._begin[first : first + len(counts)] = self._n_ids + np.cumsum(counts) - counts
        self._n_ids, self._n_known = self._n_ids + len(ids), first + len(counts)
        return first

    def _slots(self) -> None:
        """A hash table from pairs of ids to merges: two tries for each pair, a search for the few others."""
        self._bits = 20
        slot = self._hash(self._keys, 0)
        self._table = np.full((2, 1 << self._bits), -1, np.int32)
        order = np.arange(len(self._keys), dtype=np.int32)
        self._table[0, slot[::-1]] = order[::-1]
        rest = order[self._table[0, slot] != order]
        second = self._hash(self._keys[rest], 1)
        self._table[1, second[::-1]] = rest[::-1]
        self._late = np.sort(self._keys[rest[self._table[1, second] != rest]])

    def _hash(self, keys: np.ndarray, n: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[n])) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _merges_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of the merge of each pair of ids, or that of no merge."""
        none = len(self._keys)
        keys = left << 32 | right
        found = np.full(keys.shape, none, np.int64)
        for n in (0, 1):
            got = self._table[n, self._hash(keys, n)]
            hit = (got >= 0) & (self._keys[got] == keys)
            found[hit] = got[hit]
        if len(self._late):
            for k in np.flatnonzero(np.isin(keys, self._late)):
                found.flat[k] = np.searchsorted(self._keys, keys.flat[k])
        return found

    def _merge_rows(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte-pair merges of each row (ids, -1 beyond its length): the rows' final ids and lengths."""
        none, big = len(self._keys), np.iinfo(np.int64).max
        rank = np.append(self._rank, big)
        made = np.append(self._made, -1)
        ids, lengths = ids.copy(), lengths.copy()
        inside = np.arange(ids.shape[1] - 1) < (lengths - 1)[:, None]
        pair = np.full(inside.shape, none, np.int64)
        pair[inside] = self._merges_of(ids[:, :-1][inside], ids[:, 1:][inside])
        active = np.arange(len(ids))
        a, p, n = ids, pair, lengths
        columns = np.arange(ids.shape[1])
        while len(active):
            ranks = rank[p]
            at = ranks.argmin(axis=1)
            row = np.arange(len(active))
            live = ranks[row, at] < big
            if not live.all():
                done = ~live
                ids[active[done]], lengths[active[done]] = a[done], n[done]
                active, a, p, n, at = active[live], a[live], p[live], n[live], at[live]
                row = np.arange(len(active))
                if not len(active):
                    break
            joined = made[p[row, at]]
            # everything right of the pair moves one to the left
            source = np.minimum(columns + (columns > at[:, None]), len(columns) - 1)
            a = np.take_along_axis(a, source, 1)
            a[row, at] = joined
            n = n - 1
            a[row, n] = -1
            p = np.take_along_axis(p, np.minimum(source[:, :-1], p.shape[1] - 1), 1)
            p[row, np.maximum(n - 1, 0)] = none
            for k, ok in ((at - 1, at > 0), (at, at < n - 1)):
                r = row[ok]
                c = k[ok]
                p[r, c] = self._merges_of(a[r, c], a[r, c + 1])
        return ids, lengths

    def _encode_words(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, whose bytes follow one another, and the number of ids of each word."""
        if not len(sizes):
            return np.empty(0, self.dtype), sizes
        ends = np.cumsum(sizes)
        symbols = flat.astype(np.int64)
        symbols[ends - 1] += self._mark
        cut = ~self.joins[symbols[:-1], symbols[1:]] if len(symbols) > 1 else np.zeros(0, bool)  # the forced boundaries
        starts = np.zeros(len(symbols), bool)
        starts[1:] = cut
        starts[ends - sizes] = True
        begin = np.flatnonzero(starts)
        length = np.diff(np.append(begin, len(symbols)))
        first = self._first[symbols]
        counts = np.ones(len(begin), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        single = np.flatnonzero(length == 1)
        kept.append((single, first[begin[single]][:, None]))
        low = 1
        for high in (2, 4, 8, 12, 16, 24, 32, SHORT):
            pick = np.flatnonzero((length > low) & (length <= high))
            low = high
            if len(pick):
                place = np.arange(high)
                valid = place < length[pick][:, None]
                block = np.where(valid, first[np.minimum(begin[pick][:, None] + place, len(first) - 1)], -1)
                got, counts[pick] = self._merge_rows(block, length[pick])
                kept.append((pick, got))
        for k in np.flatnonzero(length > SHORT).tolist():
            text = "".join(chr(PRIVATE + s - 256) if s > 255 else self.alphabet[s] for s in symbols[begin[k] : begin[k] + length[k]].tolist())
            ids = np.asarray(self.fragments.encode(text, add_special_tokens=False).ids, np.int64)
            counts[k] = len(ids)
            kept.append((np.array([k]), ids[None, :]))
        at = np.cumsum(counts) - counts
        out = np.empty(counts.sum(), self.dtype)
        for pick, got in kept:
            place = np.arange(got.shape[1])
            valid = place < counts[pick][:, None]
            out[(at[pick][:, None] + place)[valid]] = got[valid]
        return out, np.add.reduceat(counts, np.searchsorted(begin, ends - sizes))

    def _spelled(self, token: str) -> str:
        """The token with its last symbol, if it ends a word, as one private character."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            base = token[: -len(self.suffix)]
            return base[:-1] + self._last[base[-1]] if base[-1] in self._last else token
        return token

    def fragments_of(self, word: str) -> list[str]:
        """The fragments of one word (no white space) between its forced boundaries; bytes that are no text show as such."""
        raw = word.encode("utf-8")
        symbols = [*raw[:-1], raw[-1] + self._mark]
        cuts = [0, *(i for i in range(1, len(raw)) if not self.joins[symbols[i - 1], symbols[i]]), len(raw)]
        return [raw[x:y].decode("utf-8", "backslashreplace") for x, y in zip(cuts, cuts[1:], strict=False)]

    def _pieces(self, chunk: str) -> list[bytes]:
        """The words of a normalised chunk without white space, as bytes."""
        if max(chunk) >= chr(STABLE):
            back = {c: b for b, c in enumerate(self.alphabet)}
            return [bytes(back[c] for c in w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return [w.encode("utf-8") for w in ([chunk] if chunk.isalpha() else self._pattern.findall(chunk))]

    def _learn(self, raw: list[bytes]) -> np.ndarray:
        """Put new chunks into the cache; their numbers."""
        chunks = [x.decode("utf-8") for x in raw]
        points = np.frombuffer((" ".join(chunks) + " ").encode("utf-32-le"), np.uint32)
        other = ~PLAIN[np.minimum(points, STABLE - 1)] | (points >= STABLE)
        ends = np.flatnonzero(points == 32)  # chunks hold no space
        odd = np.diff(np.append(0, np.cumsum(other)[ends])) > 1
        numbers = np.empty(len(chunks), np.int64)
        for pick, split in ((~odd, self._split_plain), (odd, self._split_other)):
            if pick.any():
                flat, sizes, upto = split(list(compress(chunks, pick)))
                ids, counts = self._encode_words(flat, sizes)
                each = np.diff(np.append(0, np.append(0, np.cumsum(counts))[upto]))
                numbers[pick] = self._keep(ids, each) + np.arange(len(each))
        return numbers

    def _split_other(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, word sizes and words so far by chunk, for any chunks without spaces."""
        normal = self.library.normalizer.normalize_str(" ".join(chunks)).split(" ")
        if len(normal) != len(chunks):  # other white space inside chunks
            normal = [self.library.normalizer.normalize_str(c) for c in chunks]
        words: list[bytes] = []
        upto = []
        for c in normal:
            for part in c.split(" ") if " " in c else (c,):
                if part:
                    words += self._pieces(part)
            upto.append(len(words))
        return np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)), np.array(upto, np.int64)

    def _split_plain(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes, word sizes and words so far by chunk, for chunks of stable characters without apostrophes.

        These need lower case only, and their words are runs of letters, single digits and runs of others.
        """
        points = np.frombuffer((" ".join(chunks).lower() + " ").encode("utf-32-le"), np.uint32)
        kind = KINDS[points]
        starts = np.empty(len(points), bool)
        starts[0] = True
        starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        space = kind == 0
        word_at = np.flatnonzero(starts & ~space)
        width = np.where(space, 0, 1 + (points >= 0x80) + (points >= 0x800))
        before = np.cumsum(width) - width
        flat = np.frombuffer("".join(chunks).lower().encode("utf-8"), np.uint8)
        sizes = np.diff(np.append(before[word_at], len(flat)))
        return flat, sizes, np.searchsorted(word_at, np.flatnonzero(space))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the whole texts, one after the other, and the number of ids of each.

        Chunks between spaces and line feeds are looked up in the cache: those of up to 8 bytes as the numbers that their
        bytes are, each different one once; longer ones as bytes.
        """
        raw = [(self._added.sub(r" \g<0> ", t) if any(x in t for x in self.added) else t).encode("utf-8") for t in texts]
        if self._n_known > CACHE_WORDS:
            self._seed()
        data = b" ".join([*raw, b""]).replace(b"\n", b" ")
        buf = np.frombuffer(data, np.uint8)
        space = np.flatnonzero(buf == 32)
        begin = np.append(0, space[:-1] + 1)[: len(space)]
        filled = space > begin
        begin, end = begin[filled], space[filled]
        size = end - begin
        number = np.empty(len(begin), np.int64)
        short = (size <= 8) & ((buf != 0).all() if len(buf) else True)  # zero bytes would look like the end of a chunk
        if short.any():
            eights = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,))
            at, upto = begin[short], end[short]
            key, first, again = np.unique(eights[at] & MASKS[size[short]], return_index=True, return_inverse=True)
            found = np.fromiter(map(self._short.get, key.tolist(), repeat(-1)), np.int64, len(key))
            new = np.flatnonzero(found < 0)
            if len(new):
                found[new] = self._learn([data[x:y] for x, y in zip(at[first[new]].tolist(), upto[first[new]].tolist(), strict=True)])
                self._short.update(zip(key[new].tolist(), found[new].tolist(), strict=True))
            number[short] = found[again]
        if not short.all():
            chunks = [data[x:y] for x, y in zip(begin[~short].tolist(), end[~short].tolist(), strict=True)]
            if absent := [x for x in set(chunks) if x not in self._long]:
                self._long.update(zip(absent, self._learn(absent).tolist(), strict=True))
            number[~short] = np.fromiter(map(self._long.__getitem__, chunks), np.int64, len(chunks))
        counts = self._count[number]
        before = np.append(0, np.cumsum(counts))
        ids = self._ids[np.repeat(self._begin[number] - before[:-1], counts) + np.arange(before[-1])]
        text_end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        return ids, np.diff(np.append(0, before[np.searchsorted(begin, text_end)]))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of the whole texts."""
        ids, counts = self.encode_flat(texts)
        return np.split(ids, np.cumsum(counts)[:-1]) if texts else []

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the whole text."""
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids, special tokens included, as the library's decode."""
        if self.decoder is None:
            return " ".join(map(self.tokens.__getitem__, ids.tolist()))
        return self.library.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryCodec:
    """One codec a Python worker."""
    return ForcedBoundaryCodec(path)


def list_array(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """Arrow lists of the given lengths from one numpy array, without a Python object for each value."""
    ends = np.append(0, np.cumsum(counts))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, ``ids`` (array of int) and ``decoded`` (string), one row for each row of ``docs``.

    A null or empty text has no ids and decodes to the empty string. Rows stay where they are: no
    shuffle, repeated rows and any other columns do not matter. A text of any length is encoded whole.
    """
    picked = docs.select(*keep, F.col(text).alias("__text"))
    kept = picked.drop("__text").schema
    schema = T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer_path)
        for b in steps(batches, "__text"):
            ids, counts = c.encode_flat(texts_of(b, "__text"))
            texts = [c.decode(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], list_array(ids, counts, pa.int32()), pa.array(texts, pa.string())], names=schema.names)

    return picked.mapInArrow(released(run), schema)
