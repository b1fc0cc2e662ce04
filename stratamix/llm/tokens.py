"""Token ids of whole texts by a public tokenizer file, memoised by word."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Words and their ids kept per Python worker, some 60 MB; beyond, all are forgotten and learnt anew.
MAX_WORDS, MAX_IDS = 1_200_000, 12_000_000
#: Slots of the table of words.
SLOTS = 1 << 21
#: Characters of texts that are split into words together.
GROUP_CHARS = 1 << 20
#: Characters of a word that are hashed by table; longer words are hashed one by one.
TABLED = 48

#: Texts of these characters are split here as the byte-level pre-tokenizer splits them; others go through the tokenizer whole.
_COMMON = re.compile(r"[\t\n -~¡-ſ]*\Z")
_LETTER, _NUMBER = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ſ]"), re.compile("[0-9²³¹¼-¾]")
_CODES = 0x180
#: Kinds of characters; END stands behind each text.
BLANK, SPACE, LETTER, NUMBER, OTHER, END = range(6)


def _kind(c: str) -> int:
    if c == "\0":
        return END
    return BLANK if c == " " else SPACE if c.isspace() else LETTER if _LETTER.match(c) else NUMBER if _NUMBER.match(c) else OTHER


_KIND = np.array([_kind(chr(c)) for c in range(_CODES)], np.uint8)
#: The same with BLANK and SPACE as one.
_CLASS = np.maximum(_KIND, SPACE)
#: A random number for each place in a word and character; their sum is the word's hash.
_RANDOM = np.random.default_rng(31).integers(0, 1 << 64, TABLED * _CODES, dtype=np.uint64)
_APOSTROPHE, _ONE, _TWO = ord("'"), [ord(c) for c in "stmd"], [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]
_APART = re.compile(r"(?<=\S) (?=\S)")
_ENCODERS: dict[str, PieceEncoder] = {}


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where the words of byte-level pre-tokenization begin, in the code points of texts that each end with a zero.

    Words are runs of letters, of numbers or of other signs, with one blank before them if there is one; the ends
    of contractions; and white space but for that blank, whose last character is a word of its own before others.
    """
    kind, class_ = _KIND[codes], _CLASS[codes]
    start = np.ones(len(codes), bool)
    np.not_equal(class_[1:], class_[:-1], out=start[1:])
    space, end = class_ == SPACE, class_ == END
    last = space[:-1] & ~(space[1:] | end[1:])
    start[:-1] |= last
    start[1:] &= ~(last & (kind[:-1] == BLANK))
    start[1:] |= end[:-1] | end[1:]
    at = np.flatnonzero((codes == _APOSTROPHE) & start)
    if len(at):
        behind = np.concatenate([codes, np.zeros(2, codes.dtype)]).astype(np.int64)
        one = np.isin(behind[at + 1], _ONE)
        two = np.isin(behind[at + 1] << 16 | behind[at + 2], _TWO)
        start[at[one | two] + 1] = False
        start[np.concatenate([at[one] + 2, at[two] + 3])] = True
    return np.flatnonzero(start)


class PieceEncoder:
    """Encodes texts to little-endian id arrays, the same ids that the tokenizer gives for each whole text.

    A byte-level tokenizer merges bytes only inside a word of its pre-tokenizer. So many texts are split into
    words at once, in arrays; words are told apart by 64-bit hashes of random numbers, and each distinct one goes
    through the tokenizer once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 0x10000 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_word = "ByteLevel(add_prefix_space=False" in repr(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None
        #: Whether an id's token begins with a blank, which a byte-level tokenizer writes as this letter.
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self._forget()

    def _forget(self) -> None:
        """An empty memo: words' numbers by hash, in a table with open addressing; where a word's ids begin and how many they are; all ids."""
        self.keys, self.numbers = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)
        self.place, self.size, self.ids = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, self.dtype)
        self.known = self.held = 0
        self._add(_RANDOM[:1])  # END has no ids

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The words' numbers, -1 for words that are not known."""
        slot, out, todo = (keys & np.uint64(SLOTS - 1)).astype(np.int64), np.full(len(keys), -1, np.int32), np.arange(len(keys))
        while len(todo):
            there = self.keys[slot[todo]]
            hit = there == keys[todo]
            out[todo[hit]] = self.numbers[slot[todo[hit]]]
            todo = todo[~hit & (there != 0)]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
        return out

    def _add(self, keys: np.ndarray) -> np.ndarray:
        """Gives numbers to distinct words that are not known."""
        numbers = np.arange(self.known, self.known + len(keys), dtype=np.int32)
        self.known += len(keys)
        slot, todo = (keys & np.uint64(SLOTS - 1)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == 0]
            self.keys[slot[free]] = keys[free]  # of several for one slot, one stays
            self.numbers[slot[free]] = numbers[free]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & (SLOTS - 1)
        return numbers

    def _raw(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 4096):
            out += [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        return out

    def _raw_words(self, words: list[str]) -> list[bytes]:
        """Words of a blank and letters follow each other in short texts: fewer calls; their first ids begin with the blank."""
        joined, apart = [], []
        for i, w in enumerate(words):
            (joined if w[0] == " " and w[1:2].isalpha() else apart).append(i)
        out = [b""] * len(words)
        for i, raw in zip(apart, self._raw([words[i] for i in apart]), strict=True):
            out[i] = raw
        if joined:
            encoded = self.tokenizer.encode_batch_fast(["".join([words[i] for i in joined[k : k + 256]]) for k in range(0, len(joined), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, self.dtype) for e in encoded])
            cuts = [*(np.flatnonzero(self.begins[ids]) * self.dtype.itemsize).tolist(), ids.nbytes]
            raw = ids.tobytes()
            for i, a, b in zip(joined, cuts[:-1], cuts[1:], strict=True):
                out[i] = raw[a:b]
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        raw = self._raw_words(words)
        new, n = np.frombuffer(b"".join(raw), self.dtype), self.known
        sizes = np.array([len(r) for r in raw]) // self.dtype.itemsize
        while n + len(keys) > len(self.place):
            self.place, self.size = np.resize(self.place, 2 * len(self.place)), np.resize(self.size, 2 * len(self.size))
        while self.held + len(new) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.place[n : n + len(keys)] = self.held + np.cumsum(sizes) - sizes
        self.size[n : n + len(keys)] = sizes
        self.ids[self.held : self.held + len(new)] = new
        self.held += len(new)
        return self._add(keys)

    def _common(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of common characters."""
        if self.known > MAX_WORDS or self.held > MAX_IDS:
            self._forget()
        whole = "\0".join([*texts, ""])
        codes = np.frombuffer(whole.encode("utf-16-le"), np.uint16)
        start = word_starts(codes)
        length = np.diff(start, append=len(codes))
        within = np.arange(len(codes), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
        np.minimum(within, TABLED - 1, out=within)
        within *= _CODES
        within += codes
        keys = np.maximum(np.add.reduceat(_RANDOM[within], start), 1)  # 0 is an empty slot
        for k in np.flatnonzero(length > TABLED).tolist():
            keys[k] = self._hash(whole[start[k] : start[k] + length[k]])
        found = pa.array(keys).dictionary_encode()
        of = found.indices.to_numpy()
        distinct = found.dictionary.to_numpy()
        numbers = self._find(distinct)
        new = np.flatnonzero(numbers < 0)
        if self.known + len(new) > SLOTS // 4 * 3:  # one group's words alone may be too many
            self._forget()
            if len(new) > SLOTS // 2:
                return [np.frombuffer(raw, self.dtype) for raw in self._raw(texts)]
            numbers = self._find(distinct)
            new = np.flatnonzero(numbers < 0)
        if len(new):
            first = np.empty(len(distinct), np.int64)
            first[of[::-1]] = np.arange(len(of))[::-1]
            first = first[new]
            numbers[new] = self._learn(distinct[new], [whole[x:y] for x, y in zip(start[first].tolist(), (start[first] + length[first]).tolist(), strict=True)])
        sizes = self.size[numbers][of]
        stop = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.place[numbers][of] - (stop - sizes), sizes) + np.arange(stop[-1])]
        return np.split(ids, stop[np.flatnonzero(codes[start] == 0)])[:-1]

    @staticmethod
    def _hash(word: str) -> int:
        import xxhash

        return xxhash.xxh64_intdigest(word.encode())

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, self.dtype)] * len(texts)
        group: list[tuple[int, str]] = []
        held = 0

        def solve() -> None:
            for (i, _), ids in zip(group, self._common([t for _, t in group]), strict=True):
                out[i] = np.concatenate([out[i], ids]) if len(out[i]) else ids
            group.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or not _COMMON.match(text) or any(s in text for s in self.special):
                out[i] = np.frombuffer(self._raw([text])[0], self.dtype)
                continue
            at = 0
            while at < len(text):  # a long text is cut at single blanks, where words begin
                cut = _APART.search(text, at + GROUP_CHARS) if len(text) - at > 2 * GROUP_CHARS else None
                stop = cut.start() if cut else len(text)
                group.append((i, text[at:stop]))
                held += stop - at
                at = stop
                if held >= GROUP_CHARS:
                    solve()
                    held = 0
        if group:
            solve()
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_many([text])[0]


def in_groups(keys: list, texts: Iterable, most_chars: int = 1 << 20) -> Iterator[tuple[list, list]]:
    """Neighbouring (keys, texts) of about ``most_chars`` characters at most, or one longer text; texts are Arrow scalars."""
    ks, ts, held = [], [], 0
    for key, text in zip(keys, texts, strict=True):
        ks.append(key)
        ts.append(text.as_py())
        held += len(ts[-1] or "")
        if held >= most_chars:
            yield ks, ts
            ks, ts, held = [], [], 0
    if ks:
        yield ks, ts


def encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
