"""Public tokenizers with a word cache: ids come as little-endian unsigned 32-bit bytes."""

from __future__ import annotations

import base64
import os
import re
from itertools import chain

import numpy as np

from .common import WHITE, blocks, mix, word_spans

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.tiktoken"
#: Most units of words, with four times as many ids, that a worker's cache takes before it begins anew, and its places, as a power of two.
CACHE_WORDS, PLACES = 2_000_000, 21
#: Characters of texts that are looked up at once.
BLOCK = 1 << 20
#: Punctuation that may follow a word without changing how it is split; not the apostrophe, which begins endings.
_AFTER = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TAIL = np.isin(np.arange(256), list(_AFTER.encode()))
#: Bytes of other characters than small letters below U+0250: all but a to z, the lead bytes of U+00C0 to U+023F, and those that follow a lead byte.
_ODD = ~np.isin(np.arange(256), [*range(97, 123), *range(0xC3, 0xC9), *range(0x80, 0xC0)])
#: Masks of the first bytes of a lane.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_loaded: dict = {}


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; another path may be given in place of a name."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def forget() -> None:
    """Give back a worker's models and caches; operators that use none call this as they start."""
    _loaded.clear()


class WordBpe:
    """The word-level BPE. It drops white space and never merges across it, so a text's ids are those of its words, one after another.

    Words are spans of a block's bytes. A word of letters below U+0250 splits into those and
    the punctuation after them, any other is one unit. A unit of at most 15 bytes is itself
    the key, as two 64-bit lanes, of a table with one place for each hash; what is not there
    is encoded once a block. Units of letters go to the BPE model without the normaliser and
    the splitter, which would find nothing to do once they are lower-cased; all others take
    the whole tokenizer.
    """

    def __init__(self, name: str = WORD_BPE):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(vocabulary(name))
        self.bare = Tokenizer.from_file(vocabulary(name))
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.model.get_vocab_size(with_added_tokens=True)
        self.ends = np.array([(self.model.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.shown = np.arange(256, dtype="<u2")
        self.shown[hidden] = 256 + np.arange(len(hidden))
        self.shown[32] = 32
        self._clear()

    def _clear(self) -> None:
        """Forget all units: lanes, first id and number of ids by place, the ids, and longer units by their bytes."""
        self.low, self.high = np.zeros(1 << PLACES, np.uint64), np.zeros(1 << PLACES, np.uint64)
        self.begin, self.count = np.zeros(1 << PLACES, np.int32), np.zeros(1 << PLACES, np.int32)
        self.store, self.used, self.words = np.zeros(1 << 16, np.uint32), 0, 0
        self.long: dict[bytes, tuple[int, int]] = {}

    def _whole(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, one after another, and how many each has."""
        own = [e.ids for e in self.model.encode_batch_fast([raw[i:j].tobytes().decode() for i, j in zip(starts.tolist(), ends.tolist())], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(own), np.uint32), np.fromiter(map(len, own), np.int64, len(own))

    def _letters(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As _whole(), of words of letters: each ends with its only token that carries the word end."""
        out = []
        for i in range(0, len(starts), 2000):
            a, b = starts[i : i + 2000], ends[i : i + 2000]
            after = np.cumsum(b - a + 1)
            text = raw[np.repeat(b + 1 - after, b - a + 1) + np.arange(after[-1])]
            text[after - 1] = 32
            shown = self.shown[text].tobytes().decode("utf-16-le")
            ids = np.asarray(self.bare.encode_batch_fast([shown], add_special_tokens=False)[0].ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            out.append((ids, np.diff(stop, prepend=0)) if len(stop) == len(a) else self._whole(raw, a, b))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _add(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keep the ids of units: first id in the store and number of ids of each."""
        need = self.used + len(ids)
        if need > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.zeros(2 * need - self.used, np.uint32)])
        self.store[self.used : need] = ids
        begin = self.used + np.cumsum(n) - n
        self.used, self.words = need, self.words + len(n)
        return begin, n

    def _find(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First id in the store and number of ids of each unit; raw has 16 bytes more than the units reach."""
        length = ends - starts
        lane = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        low = lane[starts] & _KEEP[np.minimum(length, 8)]
        high = lane[starts + 8] & _KEEP[np.clip(length - 8, 0, 7)] | np.minimum(length, 16).astype(np.uint64) << np.uint64(56)
        place = (mix(low ^ mix(high)) >> np.uint64(64 - PLACES)).astype(np.int64)
        begin, count = self.begin[place].astype(np.int64), self.count[place].astype(np.int64)
        known = (self.low[place] == low) & (self.high[place] == high)
        short = length < 16
        for kind, encode in ((letters, self._letters), (~letters, self._whole)):
            new = np.flatnonzero(kind & short & ~known)
            if not len(new):
                continue
            order = new[np.lexsort((low[new], high[new]))]
            fresh = np.ones(len(order), bool)
            fresh[1:] = (low[order[1:]] != low[order[:-1]]) | (high[order[1:]] != high[order[:-1]])
            first = order[fresh]
            b, n = self._add(*encode(raw, starts[first], ends[first]))
            of = np.cumsum(fresh) - 1
            begin[order], count[order] = b[of], n[of]
            at, one = np.unique(place[first], return_index=True)
            self.low[at], self.high[at], self.begin[at], self.count[at] = low[first[one]], high[first[one]], b[one], n[one]
        if len(rest := np.flatnonzero(~short)):
            units = [raw[i:j].tobytes() for i, j in zip(starts[rest].tolist(), ends[rest].tolist())]
            new = {x: i for x, i in zip(units, rest.tolist()) if x not in self.long}
            if new:
                first = np.array(list(new.values()))
                b, n = self._add(*self._whole(raw, starts[first], ends[first]))
                self.long.update(zip(new, zip(b.tolist(), n.tolist())))
            begin[rest], count[rest] = np.array([self.long[x] for x in units]).T
        return begin, count

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block of texts, the first id of each word, the first word of each text (the last two with an entry for the total)."""
        same = [i for i, x in enumerate(texts) if "Σ" in x or "<|" in x]  # the tokenizer would lower-case these otherwise
        lowered = [x.lower() for x in texts]
        for i in same:
            lowered[i] = texts[i]
        parts = [x.encode() for x in lowered]
        at = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)])
        padded = np.frombuffer(b"".join([*parts, bytes(16)]), np.uint8)
        raw = padded[:-16]
        starts, ends, first = word_spans(raw, at)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64), first
        odd = _ODD[raw]
        odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs of multiplication and division
        for i in same:
            odd[at[i] : at[i + 1]] |= raw[at[i] : at[i + 1]] >= 0x80
        place = np.arange(1, len(raw) + 1, dtype=np.int32)
        place[_TAIL[raw]] = 0
        middle = np.maximum(np.maximum.accumulate(place)[ends - 1], starts)  # after the last byte that is no punctuation
        odds = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(odd, out=odds[1:], dtype=np.int32)
        letters = (middle > starts) & (odds[middle] == odds[starts])
        middle = np.where(letters, middle, ends)
        begin, count = np.zeros((len(starts), 2), np.int64), np.zeros((len(starts), 2), np.int64)
        begin[:, 0], count[:, 0] = self._find(padded, starts, middle, letters)
        tail = np.flatnonzero(middle < ends)
        begin[tail, 1], count[tail, 1] = self._find(padded, middle[tail], ends[tail], np.zeros(len(tail), bool))
        total = np.concatenate([[0], np.cumsum(count.ravel())])
        ids = self.store[np.repeat(begin.ravel() - total[:-1], count.ravel()) + np.arange(total[-1])]
        return ids, total[::2], first

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text."""
        return [own for own, _ in self.ids_and_heads(texts, [""] * len(texts))]

    def ids_and_heads(self, texts: list[str], heads: list[str]) -> list[tuple[bytes, int]]:
        """Ids of each whole text, and how many of them are of words that begin in its head (a prefix that ends in white space)."""
        out: list[tuple[bytes, int]] = []
        for i, j in blocks(np.concatenate([[0], np.cumsum([len(x) for x in texts], dtype=np.int64)]), BLOCK):
            if len(texts[i]) > BLOCK and len(cuts := pieces(texts[i], BLOCK)) > 1:
                parts = [self.ids_and_heads([texts[i][a:b]], [heads[i][a:b]])[0] for a, b in cuts]
                out.append((b"".join(own for own, _ in parts), sum(n for _, n in parts)))
                continue
            if self.words > CACHE_WORDS or self.used > 4 * CACHE_WORDS:
                self._clear()
            ids, at, first = self._block(texts[i:j])
            own = [x.encode() for x in heads[i:j]]
            _, _, before = word_spans(np.frombuffer(b"".join(own), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)]))
            edges, prompts = at[first].tolist(), (at[first[:-1] + np.diff(before)] - at[first[:-1]]).tolist()
            out += [(ids[a:b].tobytes(), n) for a, b, n in zip(edges, edges[1:], prompts)]
        return out


def pieces(text: str, most: int) -> list[tuple[int, int]]:
    """Where to cut a text behind white space into parts of at most ``most`` characters, or of one longer word."""
    out, at = [], 0
    while len(text) - at > most:
        end = 1 + max(text.rfind(c, at, at + most) for c in WHITE)
        if not end:
            found = _WHITE.search(text, at + most)
            end = found.end() if found else len(text)
        out.append((at, end))
        at = end
    return out + [(at, len(text))] * (at < len(text))


def word_bpe(name: str = WORD_BPE) -> WordBpe:
    """One model a worker."""
    if name not in _loaded:
        _loaded[name] = WordBpe(name)
    return _loaded[name]


class ByteBpe:
    """The byte-level BPE, which loses nothing: token lengths in bytes give every token's place in the text."""

    def __init__(self, name: str = BYTE_BPE):
        import public_tokenizers
        import tiktoken

        with open(vocabulary(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, k in ranks.items():
            self.size[k] = len(token)

    def ends(self, text: str) -> np.ndarray:
        """The byte after each token of the whole text."""
        return np.cumsum(self.size[np.asarray(self.model.encode_ordinary(text), np.int64)])


def byte_bpe(name: str = BYTE_BPE) -> ByteBpe:
    if name not in _loaded:
        _loaded[name] = ByteBpe(name)
    return _loaded[name]
