"""Token ids of whole texts, inside tasks: each distinct word is encoded once per worker and found again by its hash."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from .hashing import ASCII_SPACE, SpanHasher, spans, windows

#: Characters of text that are handled at once; distinct words that a worker remembers (about 40 bytes each), and the
#: bytes of one beyond which it isn't remembered.
SLICE_CHARS, WORDS, LONG = 1 << 20, 500_000, 200

_PUNCTUATION, _WORD_END = np.zeros(256, bool), np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_WORD_END[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


class HashTable:
    """Slots for 64-bit hashes that are random already, with three numbers each; it doubles when half full."""

    def __init__(self, bits: int = 14):
        self.used = 0
        self._empty(bits)

    def _empty(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.start, self.length, self.met = np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, np.uint32), np.zeros(1 << bits, bool)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(slot, whether it has the hash) of each hash; otherwise the slot is free."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            k = self.keys[at[todo]]
            todo = todo[(k != h[todo]) & (k != 0)]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return at, self.keys[at] == h

    def add(self, h: np.ndarray, start: np.ndarray, length: np.ndarray, met: np.ndarray | bool = False) -> None:
        """h: distinct hashes that aren't there."""
        if 2 * (self.used + len(h)) > len(self.keys):
            self.keep(self.keys != 0, max(self.bits + 1, int(2 * (self.used + len(h))).bit_length()))
        at, _ = self.find(h)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]
            todo = todo[self.keys[at[todo]] != h[todo]]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        self.start[at], self.length[at], self.met[at] = start, length, met
        self.used += len(h)

    def keep(self, which: np.ndarray, bits: int) -> None:
        """Goes on with some of the slots only."""
        held = [x[which] for x in (self.keys, self.start, self.length, self.met)]
        self._empty(bits)
        self.add(*held)


class WordEncoder:
    """Ids as the tokenizer gives them for whole texts without special tokens.

    The tokenizer drops white space and never joins anything across it, so the ids of a text are those of its words
    between ASCII white space, one after another.  A word is split once more, into what ends in a letter or digit and
    the ASCII marks after that ("here,"), which the tokenizer takes apart too; words differ by more than case.  What
    could hold a special token stays whole and isn't remembered, like words of more than LONG bytes.  New words of
    letters are encoded many at once and told apart by the ids that end a word; whatever else there is, by the end
    token.  Remembered words are told by 64-bit hashes; at the limit, those that were met once are forgotten.
    """

    def __init__(self, path: str, end: str = "<|endoftext|>", words: int = WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.limit = Tokenizer.from_file(path), end, words
        vocabulary = self.tokenizer.get_vocab()
        self.end_id = self.tokenizer.token_to_id(end)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.ends_word) <= 1 << 16 else np.uint32
        self.table, self.flat, self.used = HashTable(), np.empty(1 << 14, self.kind), 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _encoded(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words in some order, the number of ids of each, the ids)."""
        letters = np.fromiter(map(str.isalpha, words), bool, len(words))
        simple, other = np.flatnonzero(letters), np.flatnonzero(~letters).tolist()
        order, lengths, flat = [], [], []
        for i in range(0, len(simple), 500):
            part = simple[i : i + 500]
            ids = self._ids(" ".join([words[k] for k in part.tolist()]))
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(part):
                order.append(part)
                lengths.append(np.diff(cuts, prepend=0))
                flat.append(ids)
            else:
                other += part.tolist()
        safe = [k for k in other if "<|" not in words[k]]
        for i in range(0, len(safe), 500):
            part = safe[i : i + 500]
            ids = self._ids(f" {self.end} ".join([words[k] for k in part]))
            ends = ids == self.end_id
            order.append(np.array(part))
            lengths.append(np.diff(np.flatnonzero(np.concatenate([[True], ends, [True]]))) - 1)
            flat.append(ids[~ends])
        for k in (k for k in other if "<|" in words[k]):
            flat.append(self._ids(words[k]))
            order.append(np.array([k]))
            lengths.append(np.array([len(flat[-1])]))
        return tuple(np.concatenate(x) for x in (order, lengths, flat))

    def _append(self, ids: np.ndarray, at: int) -> None:
        """Writes to flat from a place on."""
        end = at + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.empty(max(end - at, len(self.flat)), self.kind)])
        self.flat[at:end] = ids

    def _forget(self) -> None:
        t = self.table
        kept = np.flatnonzero((t.keys != 0) & t.met)
        if 2 * len(kept) > self.limit:
            kept = kept[:0]
        lengths = t.length[kept].astype(np.int64)
        ends = np.cumsum(lengths)
        self.flat = self.flat[np.repeat(t.start[kept] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        self.used = len(self.flat)
        t.start[kept], t.met[:] = ends - lengths, False
        t.keep(kept, t.bits)

    def _window(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start of each unit in part, where its ids end among those of all, the ids)."""
        first, last = spans(ASCII_SPACE[part])
        whole = np.zeros(len(first), bool)
        odd = np.flatnonzero((part[:-1] == 60) & (part[1:] == 124)) if len(part) > 1 else np.zeros(0, np.int64)
        whole[np.searchsorted(first, odd, "right") - 1] = True
        # what stands before the marks at the end of a word
        place = np.where(_PUNCTUATION[part], -1, np.arange(len(part)))
        cut = np.maximum.accumulate(place)[last - 1] + 1 if len(last) else last
        before = part[cut - 1] if len(cut) else part[:0]
        latin = (before >= 128) & (part[cut - 2] == 0xC3) & (before != 0x97) & (before != 0xB7) & (cut - 2 >= first) if len(cut) else whole
        split = (cut > first) & (cut < last) & ~whole & (_WORD_END[before] | latin)
        start = np.sort(np.concatenate([first, cut[split]]), kind="stable")
        end = np.sort(np.concatenate([last, cut[split]]), kind="stable")
        alone = end - start > LONG
        alone[np.searchsorted(start, first[whole])] = True

        h = SpanHasher(part)(start, end)
        h[h == 0] = 1
        if self.table.used > self.limit:
            self._forget()
        slot, known = self.table.find(h)
        self.table.met[slot[known]] = True
        new = np.flatnonzero(~known & ~alone)
        if len(new):
            fresh, which = np.unique(h[new], return_index=True)
            which = new[which]
            raw = part.tobytes()
            order, n, ids = self._encoded([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)])
            self._append(ids, self.used)
            self.table.add(fresh[order], self.used + np.cumsum(n) - n, n)
            self.used += len(ids)
            slot, known = self.table.find(h)
        begin, length = self.table.start[slot].astype(np.int64), self.table.length[slot].astype(np.int64)
        which = np.flatnonzero(alone)
        if len(which):
            raw = part.tobytes()
            arrays = [self._ids(raw[a:b].decode("utf-8", "surrogatepass")) for a, b in zip(start[which].tolist(), end[which].tolist(), strict=True)]
            length[which] = [len(x) for x in arrays]
            begin[which] = self.used + np.cumsum(length[which]) - length[which]
            self._append(np.concatenate(arrays), self.used)
        ends = np.cumsum(length)
        ids = self.flat[np.repeat(begin - (ends - length), length) + np.arange(int(length.sum()))]
        return start, ends, ids

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers."""
        if not texts:
            return []
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        begins = np.cumsum([0, *(len(x) + 1 for x in raw)])[1:-1]
        starts, ends, out, n = [], [np.zeros(1, np.int64)], [], 0
        for a, b in windows(data):
            s, e, ids = self._window(data[a:b])
            starts.append(s + a)
            ends.append(e + n)
            out.append(ids)
            n += len(ids)
        cuts = np.concatenate(ends)[np.searchsorted(np.concatenate(starts), begins)]
        return np.split(np.concatenate(out).astype(np.uint32), cuts)


def text_slices(batches: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about SLICE_CHARS characters each; a longer text comes alone.  Null text is empty."""
    for batch in batches:
        ids, column = batch.column(id_col), batch.column(text_col)
        sizes = np.cumsum(np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)) if len(column) else []
        a = 0
        while a < len(column):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + SLICE_CHARS, "right")))
            yield ids.slice(a, b - a).to_pylist(), [t or "" for t in column.slice(a, b - a).to_pylist()]
            a = b


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(path: str | None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
