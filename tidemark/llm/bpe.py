"""Byte-pair encoding helpers used inside tasks: an exact fast splitter and cached pieces.

Byte-level BPE first cuts a text into pieces (words with their leading space, digit runs,
punctuation runs, white space) and then merges inside each piece only. Texts repeat pieces, so all
work is done once per distinct piece of a task and looked up afterwards.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: The splitter's published pattern, and the same cut for the standard library; both are used only
#: for characters that ``Vocabulary`` has found to be cut as the vocabulary's own splitter does.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters from here on always take the tokenizer library's own splitter.
_PROBED = 0x2200
#: Distinct pieces that a task keeps; when there are more, the cache starts anew.
CACHE_PIECES = 600_000
#: Prefixes of up to so many bytes are remembered across pieces.
REMEMBERED = 32
_CONTRACTED = {"'re", "'ve", "'ll"}


class Vocabulary:
    """A byte-level BPE vocabulary file of the ``tokenizers`` library, without normaliser."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.normalizer is not None:
            raise ValueError("only vocabularies without a normaliser are supported")
        special = self.library.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in special.values()):
            raise ValueError("special tokens that strip or need word borders are not supported")
        self.special = {t.content: i for i, t in special.items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        letters = _byte_letters()
        self.ranks = {
            bytes(letters[c] for c in token): i
            for token, i in self.library.get_vocab(with_added_tokens=False).items()
            if token not in self.special
        }
        self.plain = tiktoken.Encoding("own", pat_str=_PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        self.core = self.plain._core_bpe
        self._odd = self._probe()

    def _probe(self) -> re.Pattern:
        fast, own, odd = re.compile(_FAST), self.library.pre_tokenizer, []
        self._fast = fast.findall
        for code in range(_PROBED):
            c = chr(code)
            probe = f"a{c}1{c}!{c}"
            cut = [probe[a:b] for _, (a, b) in own.pre_tokenize_str(probe)]
            ids = [i for piece in cut for i in self.encode_piece(piece.encode())]
            if fast.findall(probe) != cut or self.plain.encode_ordinary(probe) != ids:
                odd.append(re.escape(c))
        return re.compile(f"[{''.join(odd)}{chr(_PROBED)}-\U0010ffff]")

    def segments(self, text: str):
        """(plain text, special token after it or None), in order."""
        at = 0
        for m in self._special.finditer(text):
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def has_special(self, text: str) -> bool:
        return any(s in text for s in self.special)

    def is_safe(self, text: str) -> bool:
        return self._odd.search(text) is None

    def split(self, text: str) -> list[str]:
        """The pieces of a text without special tokens."""
        if self.is_safe(text):
            return self._fast(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def encode_piece(self, piece: bytes) -> list[int]:
        rank = self.ranks.get(piece)
        return [rank] if rank is not None else self.core.encode_single_piece(piece)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies, and their bytes: printable bytes stand
    for themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    return Vocabulary(path)


class Store(dict):
    """Distinct pieces, numbered; each has a run of integers in one flat array."""

    def __init__(self, run_of) -> None:
        super().__init__()
        self.run_of = run_of
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self._flat, self._start, self._size = array("i"), array("q"), array("q")

    def __missing__(self, piece: str) -> int:
        code = self[piece] = len(self._start)
        run = self.run_of(piece)
        self._start.append(len(self._flat))
        self._size.append(len(run))
        self._flat.extend(run)
        return code

    def codes(self, pieces: list[str]) -> np.ndarray:
        """Call before the other methods, which hold for these codes; may start the cache anew."""
        if len(self) > CACHE_PIECES or len(self._flat) > 8 * CACHE_PIECES:
            self._reset()
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))

    def sizes(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self._size, copy=False)[codes] if len(codes) else np.empty(0, np.int64)

    def lasts(self, codes: np.ndarray) -> np.ndarray:
        """The last integer of each run; runs aren't empty."""
        at = np.array(self._start, copy=False)[codes] + self.sizes(codes) - 1
        return np.array(self._flat, copy=False)[at]

    def gather(self, codes: np.ndarray) -> np.ndarray:
        """The runs, one after the other."""
        if not len(codes):
            return np.empty(0, np.int32)
        size = self.sizes(codes)
        ends = size.cumsum()
        at = np.repeat(np.array(self._start, copy=False)[codes] - (ends - size), size)
        at += np.arange(ends[-1])
        return np.array(self._flat, copy=False)[at]


class PrefixCounter:
    """Exact token count at every prefix of a piece, by dynamic programming.

    The encoding of a prefix is the encoding of a shorter prefix plus one last token. That token is
    the only one of the vocabulary's tokens ending there that stays next to the shorter prefix's
    own last token when the two are encoded together; so each prefix needs its last token's length
    and one addition, and the work is linear in the text.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.by_id = {i: token for token, i in vocab.ranks.items()}
        self.base = max(self.by_id) + 1
        self.longest = max(map(len, vocab.ranks))
        self.beside: dict[int, bool] = {}  # left token * base + right token
        self.known: dict[bytes, int] = {}  # of short prefixes: count * base + last token

    def _stays(self, left: int, right: int) -> bool:
        if len(self.beside) > 4 * CACHE_PIECES:
            self.beside.clear()
        found = self.vocab.encode_piece(self.by_id[left] + self.by_id[right]) == [left, right]
        self.beside[left * self.base + right] = found
        return found

    def _last(self, piece: bytes, end: int, states: list[int]) -> int:
        ranks, base, beside = self.vocab.ranks, self.base, self.beside
        for size in range(1, min(end, self.longest) + 1):
            right = ranks.get(piece[end - size : end])
            if right is not None:
                if size == end:
                    return base + right
                state = states[end - size]
                left = state % base
                fits = beside.get(left * base + right)
                if fits or fits is None and self._stays(left, right):
                    return state - left + base + right
        raise ValueError("no last token fits; not a byte-level BPE vocabulary")

    def by_byte(self, piece: bytes) -> list[int]:
        known, base = self.known, self.base
        if len(known) > CACHE_PIECES:
            known.clear()
        states = [0]
        for end in range(1, len(piece) + 1):
            if end > REMEMBERED:
                states.append(self._last(piece, end, states))
                continue
            prefix = piece[:end]
            state = known.get(prefix)
            if state is None:
                rank = self.vocab.ranks.get(prefix)
                state = known[prefix] = base + rank if rank is not None else self._last(piece, end, states)
            states.append(state)
        return [state // base for state in states[1:]]

    def by_character(self, piece: str) -> list[int]:
        raw = piece.encode()
        counts = self.by_byte(raw)
        if len(raw) != len(piece):
            counts = [n for n, c in zip(counts, raw[1:] + b"a", strict=True) if c & 0xC0 != 0x80]
        if piece in _CONTRACTED:  # cut after its first letter, the splitter has an apostrophe and a letter
            counts[1] = 2
        return counts


class PrefixTable:
    """Counts at every character prefix of whole texts, from the pieces' own tables."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.store = Store(PrefixCounter(vocab).by_character)

    def counts(self, text: str) -> np.ndarray:
        """``counts[i]``: tokens of ``text[: i + 1]``."""
        parts, base = [], 0
        for plain, special in self.vocab.segments(text):
            # inside a special token, the text so far is ordinary text
            within = self._plain(plain + special[:-1] if special else plain)
            parts.append(within + base)
            if special:
                base += (int(within[len(plain) - 1]) if plain else 0) + 1
                parts.append(np.array([base], within.dtype))
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _plain(self, text: str) -> np.ndarray:
        pieces, store = self.vocab.split(text), self.store
        codes = store.codes(pieces)
        within = store.gather(codes)
        if not len(within):
            return within
        size, finals = store.sizes(codes), store.lasts(codes)
        ends = finals.cumsum(dtype=np.int32)
        out = within + np.repeat(ends - finals, size)
        # a run of white space that ends the prefix is one piece, though a word takes its last space
        spaces = [k for k in range(len(pieces) - 1) if pieces[k].isspace() and pieces[k + 1][0].isspace()]
        if spaces:
            runs = store.lasts(np.array([store[pieces[k] + pieces[k + 1][0]] for k in spaces]))
            out[size.cumsum()[spaces]] = (ends - finals)[spaces] + runs
        return out


class Encoder:
    """Token ids of whole texts."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab

    def _plain(self, text: str) -> list[int]:
        if self.vocab.is_safe(text):
            return self.vocab.plain.encode_ordinary(text)
        return [i for piece in self.vocab.split(text) for i in self.vocab.encode_piece(piece.encode())]

    def ids(self, text: str) -> list[int]:
        if not self.vocab.has_special(text):
            return self._plain(text)
        ids: list[int] = []
        for plain, special in self.vocab.segments(text):
            ids += self._plain(plain)
            if special:
                ids.append(self.vocab.special[special])
        return ids
