"""Cutting texts into words in whole blocks, and ids of distinct words, for the tokenizer operators."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of text after which a block of documents is closed; a document is never cut over two blocks.
BLOCK_CHARS = 8 << 20
#: Code points that are cut at once; longer texts are cut in slices between a non-blank and a space.
SLICE_CHARS = 1 << 20
#: Distinct words whose ids a worker keeps, and as many of an older generation.
KEEP = 400_000

_LETTER, _NUMBER, _BLANK, _OTHER = range(4)


@functools.cache
def _classes() -> np.ndarray:
    """For every code point: letter, number, white space or anything else, as the tokenizer library itself reads its patterns.

    Unicode editions differ between regex engines, so the library is asked: with a vocabulary of single bytes it gives back
    the bytes of what a pattern matches.
    """
    import tiktoken

    out = np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_BLANK, r"\s")):
        single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for at in range(0, 0x110000, 1 << 11):
            if not 0xD800 <= at < 0xE000:  # surrogates are no characters
                found = bytes(single.encode_ordinary("".join(map(chr, range(at, at + (1 << 11)))))).decode()
                out[[ord(c) for c in found]] = kind
    return out


def _starts(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the matches of the public splitting pattern begin, for several texts at once.

    The pattern takes, in this order: a contraction ('s 't 're 've 'm 'll 'd); a run of letters, of numbers or
    of others, each with one space before it; white space up to the last one before a word; white space.
    """
    n = len(cp)
    kind = _classes()[cp]
    edge = np.zeros(n + 1, bool)  # first places of texts, and the end
    edge[ends] = True
    edge[0] = True
    start = edge[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.zeros(n, bool)  # a blank right before a word of the same text
    last[:-1] = (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~edge[1:n]
    start |= last
    start[np.flatnonzero(last & (cp == 32)) + 1] = False
    mark = np.flatnonzero((cp == 39) & start)
    if len(mark):
        ahead = np.concatenate((cp, np.zeros(2, cp.dtype)))
        open1 = ~edge[mark + 1]
        open2 = open1 & ~edge[np.minimum(mark + 2, n)]
        a, b = ahead[mark + 1], ahead[mark + 2]
        one = open1 & np.isin(a, [ord(c) for c in "stmd"])
        two = open2 & ((np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        size = np.where(one, 1, np.where(two, 2, 0))
        hit, size = mark[size > 0], size[size > 0]
        start[hit + 1] = False
        after = hit + 1 + size
        start[after[after < n]] = True
    return start


def _spaced(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where runs of spaces with the word after them begin."""
    start = np.zeros(len(cp) + 1, bool)
    start[ends] = True
    start[0] = True
    start[1:-1] |= (cp[1:] == 32) & (cp[:-1] != 32)
    return start[:-1]


def _slices(text: str) -> list[str]:
    """``text`` in slices that begin with a space after a non-blank, where any form of cutting begins anew."""
    out, at = [], 0
    while len(text) - at > SLICE_CHARS:
        to = text.find(" ", at + SLICE_CHARS)
        while to > 0 and text[to - 1].isspace():
            to = text.find(" ", to + 1)
        if to < 0:
            break
        out.append(text[at:to])
        at = to
    return [*out, text[at:]] if at else [text]


def cut(texts: list[str], starts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[pa.ChunkedArray, np.ndarray]:
    """All words of ``texts`` in order, as UTF-8 bytes, and the number of words of each text."""
    chunks, counts = [], np.zeros(len(texts), np.int64)
    parts = [(k, s) for k, t in enumerate(texts) if t for s in _slices(t)]
    at = 0
    while at < len(parts):
        to, held = at, 0
        while to < len(parts) and (to == at or held + len(parts[to][1]) <= SLICE_CHARS):
            held += len(parts[to][1])
            to += 1
        whole = "".join(s for _, s in parts[at:to])
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) for _, s in parts[at:to]])
        begins = np.flatnonzero(starts(cp, ends))
        raw = whole.encode()
        if len(raw) == len(cp):
            places = begins
        else:
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            places = (np.cumsum(width) - width)[begins]
        offsets = np.append(places, len(raw)).astype(np.int64)
        chunks.append(pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]))
        per_part = np.diff(np.searchsorted(begins, np.concatenate(([0], ends))))
        np.add.at(counts, [k for k, _ in parts[at:to]], per_part)
        at = to
    return pa.chunked_array(chunks, pa.large_binary()), counts


def pretokens(texts: list[str]) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Words by the public splitting pattern of byte-level vocabularies."""
    return cut(texts, _starts)


def spaced_words(texts: list[str]) -> tuple[pa.ChunkedArray, np.ndarray]:
    """Words with the spaces before them; a text may end in spaces alone."""
    return cut(texts, _spaced)


def distinct(words: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Distinct words, the most frequent first, and for every place the number of its word."""
    if not len(words):
        return pa.array([], pa.large_binary()), np.zeros(0, np.uint32)
    listed = words.combine_chunks().dictionary_encode()
    index = listed.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(index, minlength=len(listed.dictionary)), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    return listed.dictionary.take(pa.array(order)), rank[index]


def spread(index: np.ndarray, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the words at all places: ``flat`` holds those of each distinct word, ``sizes`` how many. Also ids per place."""
    begin = np.cumsum(sizes) - sizes
    per_place = sizes[index]
    shift = begin[index] - (np.cumsum(per_place) - per_place)
    return flat[np.repeat(shift, per_place) + np.arange(per_place.sum())], per_place


def per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over consecutive runs of ``counts`` places."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def blocks(batches: Iterator[pa.RecordBatch], chars: int | None = None) -> Iterator[tuple[list, pa.Array, list[str]]]:
    """Documents of _rid, doc_id, text in blocks of whole texts: row numbers, ids and texts, null as empty.

    Where a block ends depends on the rows alone, not on how they arrive in batches.
    """
    rids, ids, texts, held = [], [], [], 0
    chars = chars or BLOCK_CHARS
    for b in batches:
        for at in range(0, b.num_rows, 256):  # a few texts at a time become Python objects
            part = b.slice(at, 256)
            for k, (rid, text) in enumerate(zip(part.column("_rid").to_pylist(), part.column("text").to_pylist(), strict=True)):
                rids.append(rid)
                texts.append(text or "")
                ids.append(part.column("doc_id").slice(k, 1))
                held += len(texts[-1])
                if held >= chars or len(texts) >= 1 << 17:
                    yield rids, pa.concat_arrays(ids), texts
                    rids, ids, texts, held = [], [], [], 0
    if rids:
        yield rids, pa.concat_arrays(ids), texts


def packed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids as one array, and how many each has."""
    size = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size


#: Some words -> their ids one after the other, and ids per word.
Learn = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


class WordIds:
    """Ids of words by ``learn``, each word once while it is remembered.

    With the bytes of every id in ``table``, a word that the joined bytes of its ids do not give back is refused and has no
    ids. What is remembered is about ``keep`` words; beyond that, words met once are forgotten.
    """

    def __init__(self, learn: Learn, table: pa.Array | None = None, keep: int = KEEP):
        self.learn, self.table, self.keep = learn, table, keep
        self.width = None if table is None else np.array([len(x) for x in table.to_pylist()], np.int64)
        self.known = pa.array([], pa.large_binary())
        self.flat, self.size, self.refused, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)

    def _thin(self) -> None:
        """Keep the words met most often, half of what may be remembered at most."""
        often = np.flatnonzero(self.met > 1)
        if len(often) > self.keep // 2:
            often = often[np.argsort(-self.met[often], kind="stable")[: self.keep // 2]]
        self.known = self.known.take(pa.array(often))
        self.flat, self.size = spread(often, self.flat, self.size)
        self.refused, self.met = self.refused[often], np.ones(len(often), np.int32)

    def _add(self, words: pa.Array) -> None:
        listed = words.to_pylist()
        flat, size = self.learn(listed)
        refused = np.zeros(len(listed), bool)
        if self.table is not None:
            joined = self.table.take(pa.array(flat))
            raw = joined.buffers()[2].to_pybytes() if len(joined) else b""
            ends = np.concatenate(([0], np.cumsum(self.width[flat])))[np.concatenate(([0], np.cumsum(size)))].tolist()
            if ends[-1] != sum(map(len, listed)) or raw[: ends[-1]] != b"".join(listed):
                refused = np.array([raw[p:q] != w for p, q, w in zip(ends, ends[1:], listed, strict=False)], bool)
                flat, size = flat[~np.repeat(refused, size)], np.where(refused, 0, size)
        self.known = pa.concat_arrays([self.known, words])
        self.flat, self.size, self.refused = np.concatenate((self.flat, flat)), np.concatenate((self.size, size)), np.concatenate((self.refused, refused))
        self.met = np.concatenate((self.met, np.zeros(len(listed), np.int32)))

    def look(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct words one after the other, ids per word, and which words were refused."""
        words = words.cast(pa.large_binary())
        place = self._places(words)
        new = np.flatnonzero(place < 0)
        if len(self.known) + len(new) > self.keep and (self.met > 0).any():
            self._thin()
            place = self._places(words)
            new = np.flatnonzero(place < 0)
        if len(new):
            before = len(self.known)
            self._add(words.take(pa.array(new)))
            place[new] = np.arange(before, before + len(new))
        self.met[place] += 1
        flat, sizes = spread(place, self.flat, self.size)
        return flat, sizes, self.refused[place]

    def _places(self, words: pa.Array) -> np.ndarray:
        return pc.index_in(words, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def library_words(definition: str) -> Learn:
    """Encoding of words with a byte-level vocabulary of the tokenizers library; special strings are plain text.

    Words of a space and something else are given to the library as one line per 1,000 words, which it cuts at the spaces again; the
    first id of each is one whose token begins with a space. Other words are texts of their own.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(definition)
    library.encode_special_tokens = True
    names = library.get_vocab()
    opens = np.zeros(max(names.values()) + 1, bool)
    space = next(c for c, b in byte_letters().items() if b == 32)
    for name, number in names.items():
        opens[number] = name.startswith(space)

    def learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [w.decode() for w in words]
        line = np.fromiter((t[0] == " " and not t[-1].isspace() for t in texts), bool, len(texts))
        flat, size = packed([e.ids for e in library.encode_batch_fast([texts[k] for k in np.flatnonzero(~line).tolist()], add_special_tokens=False)])
        flats, sizes = [flat], [size]
        spaced = [texts[k] for k in np.flatnonzero(line).tolist()]
        for at in range(0, len(spaced), 1000):
            part = spaced[at : at + 1000]
            ids = np.array(library.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            starts = np.flatnonzero(opens[ids])
            if len(starts) != len(part) or starts[0]:
                raise ValueError("the vocabulary marks leading spaces in another way")
            flats.append(ids)
            sizes.append(np.diff(starts, append=len(ids)))
        place = np.empty(len(texts), np.int64)
        place[np.concatenate((np.flatnonzero(~line), np.flatnonzero(line)))] = np.arange(len(texts))
        size = np.concatenate(sizes)
        return spread(place, np.concatenate(flats), size)

    return learn


def splits_publicly(made: dict) -> bool:
    """True if a vocabulary's definition cuts texts by the public pattern and changes nothing before it."""
    how = made.get("pre_tokenizer") or {}
    return how.get("type") == "ByteLevel" and how.get("use_regex", True) and not how.get("add_prefix_space") and made.get("normalizer") is None


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}
