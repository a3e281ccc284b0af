"""Byte-pair encoding and decoding in batched numpy merge rounds.

The symbols of many words stand in one flat array. A round looks every
adjacent pair up in a table of slots over the sorted pair keys, takes each word's
pair of lowest rank, and merges its occurrences from the left; words without a
known pair leave the array. The file's rules (special tokens, NFC, white space,
lower case, word pattern, byte alphabet, end-of-word suffix) come before the
rounds and are worked once per distinct white-space-delimited chunk that a task
remembers; of the pieces of its new chunks, each distinct one is merged once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import GRAM, Words, give_back, hashes, text_bytes, text_slices
from larder.session import ship_package

#: Distinct chunks a task remembers; then it starts afresh (a matter of speed only).
CHUNKS = 1 << 20
#: Bytes of text encoded at once: more of them share their chunks.
SLICE = 4 << 20
_NONE = np.int64(1 << 40)
_SLOT_BITS = 18


def word_bpe_path() -> str:
    """Where the installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], n = chr(256 + n), n + 1
    return [out[b] for b in range(256)]


def newer() -> str:
    """Code points that Unicode 3.2 had not assigned: the tables of Python, ``regex`` and the tokenizers library may differ in them."""
    old = unicodedata.ucd_3_2_0
    return "".join(c for c in map(chr, [*range(0xD800), *range(0xF900, 0x40000), *range(0xE0000, 0xE1000)]) if old.category(c) == "Cn")


def _inside(chars: list[str]) -> str:
    """The characters (sorted) as the inside of a character class."""
    late = [ord(c) for c in chars]
    start = [c for c, before in zip(late, [-1, *late], strict=False) if c != before + 1]
    end = [c for c, after in zip(late, [*late[1:], -1], strict=False) if c + 1 != after]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(start, end, strict=True))


class Newer:
    """Rules for text with code points that are newer than Unicode 3.2, by the library's own tables."""

    def __init__(self, pattern: str, chars: str):
        from tokenizers import Regex, normalizers, pre_tokenizers

        self._nfc, self._lower = normalizers.NFC(), normalizers.Lowercase()
        text = "\n".join(chars)
        for name in (r"\p{L}", r"\p{N}"):
            split = pre_tokenizers.Split(Regex(name), "removed", invert=True)
            theirs = {chars[at // 2] for _, (at, _) in split.pre_tokenize_str(text)}
            own = set(regex.findall(name, chars))
            more, less = _inside(sorted(theirs - own)), _inside(sorted(own - theirs))
            pattern = pattern.replace(name, f"[{name}{more}" + (f"--[{less}]]" if less else "]"))
        self.find = regex.compile(pattern, regex.V1).findall

    def plain(self, text: str) -> str:
        """Normal form C in lower case."""
        return self._lower.normalize_str(self._nfc.normalize_str(text))


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large binary array's values, one after the other, and where the values begin and end in them."""
    if not len(a):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset: a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", dtype=np.uint8)[at[0]: at[-1]], at - at[0]


class Bpe:
    """Encoder and decoder of one tokenizer file of the word-BPE kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        pattern += r"|\n"  # \n, no part of any piece, ends a chunk
        self._find_lines = regex.compile(pattern).findall
        self._pattern, self._chars, self._newer = pattern, newer(), None
        self._is_newer = np.zeros(0x110000, dtype=bool)
        self._is_newer[np.frombuffer(self._chars.encode("utf-32-le"), "<u4")] = True
        names = sorted(special, key=len, reverse=True)
        self._special = special
        self._split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None
        self._mark = [n.encode() for n in names]
        letters = byte_alphabet()
        self._byte = np.array([vocab[c] for c in letters], dtype=np.int64)
        self._last = np.array([vocab[c + suffix] for c in letters], dtype=np.int64)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self._size = 1 + max(vocab.values())
        born = np.full(self._size, -1)
        born[made[::-1]] = np.arange(len(pairs))[::-1]
        again = len(np.unique(made)) < len(made)
        #: a merge never makes a pair of lower rank possible: all its occurrences can be merged at once
        self._whole = not again and bool((born[left] < np.arange(len(pairs))).all() and (born[right] < np.arange(len(pairs))).all())
        key = left * self._size + right
        order = np.argsort(key)
        self._keys, self._rank, self._made = key[order], order.astype(np.int64), made[order]
        #: a pair's slot names its place in the sorted keys; of several pairs the last, the others are searched
        slot = self._slots(self._keys)
        self._slot = np.zeros(1 << _SLOT_BITS, dtype=np.int32)
        self._slot[slot] = np.arange(len(slot))
        self._crowded = np.bincount(slot, minlength=len(self._slot)) > 1
        tokens = [""] * (1 + max([*vocab.values(), *special.values()]))
        for t, i in (vocab | special).items():
            tokens[i] = t
        self._tokens = pa.array(tokens, pa.large_string())
        self._reset()

    def _reset(self) -> None:
        self._chunk = pa.array([], pa.large_binary())
        self._hash, self._place = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int32)   # of the chunks, sorted by hash
        self._ids, self._from = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * GRAM >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _look_up(self, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, at: np.ndarray, where: np.ndarray) -> None:
        """Set the rank of the pairs that begin at ``where``, and their place ``at`` in the sorted keys."""
        last = where == len(symbol) - 1
        after = np.where(last, where, where + 1)
        key = symbol[where] * self._size + symbol[after]
        slot = self._slots(key)
        place = self._slot[slot].astype(np.int64)
        known = self._keys[place] == key
        rest = np.flatnonzero(self._crowded[slot] & ~known)
        place[rest] = np.minimum(np.searchsorted(self._keys, key[rest]), len(self._keys) - 1)
        known[rest] = self._keys[place[rest]] == key[rest]
        known &= (word[where] == word[after]) & ~last
        rank[where] = np.where(known, self._rank[place], _NONE)
        at[where] = place

    def merge(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words one after the other, and how many each word has.

        raw: the words' bytes, one after the other; size: bytes of each.
        """
        symbol, last = self._byte[raw], np.cumsum(size) - 1
        last = last[size > 0]
        symbol[last] = self._last[raw[last]]
        word = np.repeat(np.arange(len(size)), size)
        rank, at = np.full(len(symbol), _NONE), np.zeros(len(symbol), dtype=np.int64)
        self._look_up(symbol, word, rank, at, np.arange(len(symbol)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.concatenate([first, [len(word)]]))
            least = np.minimum.reduceat(rank, first)
            over = least == _NONE
            if over.any():  # words in which no pair is known leave
                out = np.repeat(over, length)
                done.append((word[out], symbol[out]))
                symbol, word, rank, at = symbol[~out], word[~out], rank[~out], at[~out]
                least, length = least[~over], length[~over]
                if not len(symbol):
                    break
            where = np.flatnonzero(rank == np.repeat(least, length))
            if self._whole:  # of overlapping occurrences the first, third, ... from the left
                run = np.concatenate([[True], where[1:] != where[:-1] + 1])
                if not run.all():
                    begin = np.maximum.accumulate(np.where(run, np.arange(len(where)), 0))
                    where = where[(np.arange(len(where)) - begin) % 2 == 0]
            else:
                where = where[np.concatenate([[True], word[where][1:] != word[where][:-1]])]
            symbol[where] = self._made[at[where]]
            stay = np.ones(len(symbol), dtype=bool)
            stay[where + 1] = False
            symbol, word, rank, at = symbol[stay], word[stay], rank[stay], at[stay]
            now = where - np.arange(len(where))  # a merged symbol's new place: one is gone for each merge before it
            self._look_up(symbol, word, rank, at, now)
            self._look_up(symbol, word, rank, at, now[now > 0] - 1)
        if not done:
            return np.zeros(0, dtype=np.int32), np.zeros(len(size), dtype=np.int64)
        word, symbol = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        return symbol[np.argsort(word, kind="stable")].astype(np.int32), np.bincount(word, minlength=len(size))

    @staticmethod
    def _plain(text: str) -> str:
        """Normal form C in lower case, character by character (no final-sigma rule)."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def _chunk_ids(self, lines: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks without special tokens, a line each, one after the other, and how many each chunk has."""
        text = lines.decode()
        pieces = self._find_lines(self._plain(text)) if not self._has_newer(text) else self._newer_pieces(text)
        every = pa.array(pieces, pa.large_string()).dictionary_encode()
        distinct, of = every.dictionary.cast(pa.large_binary()), every.indices.to_numpy()
        close = of == distinct.index(b"\n").as_py()
        raw, at = _bytes(distinct)
        size = np.diff(at)
        size[of[close][:1]] = 0
        ids, size = self.merge(raw[raw != 10], size)  # no other piece has that byte
        known = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(ids))
        ids = known.take(pa.array(of)).flatten().to_numpy(zero_copy_only=False)
        return ids, np.diff(np.concatenate([[0], np.cumsum(size[of])[close]]))

    def _has_newer(self, text: str) -> bool:
        return not text.isascii() and bool(self._is_newer[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())

    def _newer_pieces(self, text: str) -> list[str]:
        """Pieces of a text of which some lines have newer code points: only those lines take the library's tables."""
        self._newer = self._newer or Newer(self._pattern, self._chars)
        pieces, plain = [], []
        for line in text.split("\n")[:-1]:
            if not self._has_newer(line):
                plain.append(line)
                continue
            pieces += self._find_lines(self._plain("\n".join([*plain, ""])))
            pieces += [*self._newer.find(self._newer.plain(line)), "\n"]
            plain = []
        return pieces + self._find_lines(self._plain("\n".join([*plain, ""])))

    def _marked_ids(self, chunk: bytes) -> np.ndarray:
        """Ids of one chunk in which special tokens stand."""
        parts = [p for p in self._split(chunk.decode()) if p]
        return np.concatenate([np.array([self._special[p]], dtype=np.int32) if p in self._special
                               else self._chunk_ids(p.encode() + b"\n")[0] for p in parts])

    def _learn(self, lines: bytes) -> None:
        """Add the ids of new chunks, a line each."""
        if any(m in lines for m in self._mark):
            chunks = lines.split(b"\n")[:-1]
            marked = {i: self._marked_ids(c) for i, c in enumerate(chunks) if any(m in c for m in self._mark)}
            ids, count = self._chunk_ids(b"\n".join([*(b"" if i in marked else c for i, c in enumerate(chunks)), b""]))
            at = np.cumsum(count)
            ids = np.insert(ids, np.repeat([at[i] for i in marked], [len(v) for v in marked.values()]), np.concatenate([*marked.values()])).astype(np.int32)
            count[list(marked)] = [len(v) for v in marked.values()]
        else:
            ids, count = self._chunk_ids(lines)
        ends = np.cumsum(count)
        self._from = np.concatenate([self._from, ends + len(self._ids)])
        self._ids = np.concatenate([self._ids, ids])

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The places of distinct chunks among the known ones; new ones become known."""
        raw, at = _bytes(chunks)
        own = hashes(np.concatenate([raw, np.zeros(9, dtype=np.uint8)]), at[:-1], at[1:])
        order = np.argsort(own)                   # near hashes are looked up together
        number = np.zeros(len(own), dtype=np.int64)
        new = np.ones(len(own), dtype=bool)
        place = np.searchsorted(self._hash, own[order])
        if len(self._hash):
            found = np.minimum(place, len(self._hash) - 1)
            hit = self._hash[found] == own[order]
            known, found = order[hit], self._place[found[hit]]
            # of chunks with one hash only the first known one is found; the others are learned again
            same = pc.equal(chunks.take(pa.array(known)), self._chunk.take(pa.array(found))).to_numpy(zero_copy_only=False)
            number[known[same]], new[known[same]] = found[same], False
        if new.any():
            more = chunks.filter(pa.array(new))
            number[new] = np.arange(len(self._chunk), len(self._chunk) + len(more))
            raw, at = _bytes(more)
            self._learn(np.insert(raw, at[1:], 10).tobytes())   # no chunk has that byte
            self._chunk = pa.concat_arrays([self._chunk, more])
            late = new[order]
            self._hash = np.insert(self._hash, place[late], own[order][late])
            self._place = np.insert(self._place, place[late], number[order][late])
        return number

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the offsets of the texts in them (``len(texts) + 1``)."""
        if len(self._chunk) > CHUNKS:
            self._reset()
        words = Words(texts)
        size = words.end - words.start
        letters = words.buf[:-9][words.buf[:-9] != 32]
        every = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64)), pa.py_buffer(letters)])
        distinct = every.dictionary_encode()  # so that each chunk of the slice is looked up once
        of = self._numbers(distinct.dictionary)[distinct.indices.to_numpy()]
        known = pa.LargeListArray.from_arrays(pa.array(self._from), pa.array(self._ids))
        found = known.take(pa.array(of))
        ids = found.flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum((self._from[1:] - self._from[:-1])[of])])
        return ids, ends[words.first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Tokens joined by one space, for each text; ids that the file does not have are left out."""
        known = (ids >= 0) & (ids < len(self._tokens))
        if not known.all():
            offsets = np.concatenate([[0], np.cumsum(known)])[offsets]
            ids = ids[known]
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self._tokens.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string())


_LOADED: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    """The worker's encoder of this file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``(doc_id, ids array<int>)`` for every row, with ``decoded`` also the text that the ids decode to.

    NULL and empty texts have no ids and decode to the empty text; repeated rows
    and ids give a row each; NULL ids stay NULL; other columns are ignored.
    ``path``: the tokenizer file, the same on all machines.
    """
    path = path or word_bpe_path()
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            for part in text_slices(batch, limit=SLICE):
                ids, at = bpe.encode(text_bytes(part))
                out = [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                yield pa.RecordBatch.from_arrays(out + [bpe.decode(ids, at)] * decoded, names=["doc_id", "ids", "decoded"][: 2 + decoded])
        give_back()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {_kind(rows, 'doc_id')}, ids array<int>" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, decoded)``: the tokens of each row's ids, special ones included, joined by one space.

    NULL and empty lists decode to the empty text; NULL and unknown ids are left out.
    """
    path = path or word_bpe_path()
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column("ids")), 0).to_numpy(zero_copy_only=False)
            flat = pc.fill_null(pc.list_flatten(batch.column("ids")).cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
            at, start = np.concatenate([[0], np.cumsum(size, dtype=np.int64)]), 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(at, at[start] + (1 << 19), side="right")) - 1)
                text = bpe.decode(flat[at[start]: at[end]], at[start: end + 1] - at[start])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, end - start), text], names=["doc_id", "decoded"])
                start = end

    got = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return got.mapInArrow(run, f"doc_id {_kind(got, 'doc_id')}, decoded string")
