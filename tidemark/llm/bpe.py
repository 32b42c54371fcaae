"""A lower-casing word BPE in Arrow tasks: texts split into chunks, ids of chunks, and exact counts at every prefix.

Only for tokenizer files whose words end where white space does, such as word_bpe_49k.json: a text's tokens are then
those of its white-space-separated chunks, one after another, and chunks recur enough to be kept.
"""

from __future__ import annotations

import json
import re
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

#: Characters for which Python's lower() and split() may differ from the library's normalizer: white space that one
#: of the two doesn't count, dotted capital I, and all beyond Latin Extended-B, where NFC can change texts.
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0İɐ-\U0010ffff]")
#: Lower-case Latin letters, and runs of anything else: where all else is ASCII without apostrophes, words end there.
_RUNS = re.compile("[a-zß-öø-ɏ]+|[^a-zß-öø-ɏ]+")
_LETTERS = re.compile("[a-zß-öø-ɏ]+")
_ALL_LETTERS = re.compile("[a-zß-öø-ɏ]+").fullmatch
_IN_RUNS = re.compile("[\x00-&(-\x7fß-öø-ɏ]+").fullmatch


#: Chunks of more characters than this are rare and aren't kept.
_LONG = 256


def byte_alphabet() -> dict[int, str]:
    """Byte -> its character in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b if b in printable else 256 + rest.index(b)) for b in range(256)}


_BYTES = byte_alphabet()
_UNBYTES = {ord(c): chr(b) for b, c in _BYTES.items()}


def as_bytes(word: str) -> str:
    """The word with each of its UTF-8 bytes as a character of the vocabulary's alphabet."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)


def _as_text(word: str) -> str:
    """The word whose bytes are the characters of the vocabulary's alphabet."""
    return word if word.isascii() else word.translate(_UNBYTES).encode("latin-1").decode("utf-8", "replace")


class Chunker:
    """Splits texts into normalised chunks; special tokens' strings are found before normalisation, as by default."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        strings = "".join("|" + re.sub(r"(\W)", r"\\\1", s) for s in self.special)
        self.odd = r"[\x1c-\x1f\x{85}\x{a0}\x{130}\x{250}-\x{10ffff}]" + strings  # _UNSURE and special tokens, for Arrow
        self.tokenizer.encode_special_tokens = True  # chunks hold none: they are split off before

    def chunks(self, text: str) -> list[str]:
        if not _UNSURE.search(text):
            return text.lower().split()
        return [c for c in self.tokenizer.normalizer.normalize_str(text).split(" ") if c]

    def runs(self, chunk: str) -> list[str] | None:
        """Parts of a chunk that are encoded one by one: runs of letters and of other ASCII; None if it must stay whole."""
        return _RUNS.findall(chunk) if _IN_RUNS(chunk) else None

    def parts(self, text: str):
        """Pairs of a special token's id (or None) and the chunks before it."""
        at = 0
        for m in self._special.finditer(text):
            yield self.chunks(text[at : m.start()]), self.special[m.group()]
            at = m.end()
        yield self.chunks(text[at:] if at else text), None


class IdTable:
    """Chunk -> its ids as little-endian unsigned 32-bit bytes; forgets all once it holds `bound` chunks, long ones at once."""

    def __init__(self, path: str, bound: int = 600_000):
        self.chunker, self.bound = Chunker(path), bound
        self.ids: dict[str, bytes] = {}
        self.bare = Tokenizer(self.chunker.tokenizer.model)  # for words of letters alone, which aren't split further
        vocab, suffix = self.chunker.spec["model"]["vocab"], self.chunker.spec["model"]["end_of_word_suffix"]
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        self.ends_word[[i for word, i in vocab.items() if word.endswith(suffix)]] = True
        self.bare.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])

    def _add_words(self, words: list[str]) -> None:
        """Words of letters, thousands in one call; the tokens that end a word tell where."""
        for k in range(0, len(words), 4096):
            own = words[k : k + 4096]
            ids = np.array(self.bare.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, "<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends_word[ids]) + 4).tolist()
            self.ids.update(zip(own, [raw[a:b] for a, b in pairwise([0, *ends])], strict=True))

    def _add(self, chunks: list[str]) -> None:
        for k in range(0, len(chunks), 4096):
            own = chunks[k : k + 4096]
            for c, e in zip(own, self.chunker.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                self.ids[c] = array("I", e.ids).tobytes()

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks."""
        if len(self.ids) > self.bound:
            self.ids.clear()
        ids = self.ids
        ids[""] = b""
        new = {c for c in chunks if c not in ids}
        words = set(filter(_ALL_LETTERS, new))
        mixed = {c: self.chunker.runs(c) or [c] for c in new - words}
        runs = {r for own in mixed.values() for r in own}.difference(ids, words)
        inside = set(filter(_ALL_LETTERS, runs))
        self._add_words([*words, *inside])
        self._add([*(runs - inside)])
        for c, own in mixed.items():
            if c not in ids:
                ids[c] = b"".join(map(ids.__getitem__, own))
        out = list(map(ids.__getitem__, chunks))
        for c in [*new, *runs]:
            if len(c) > _LONG:
                del ids[c]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text, without begin, end or other added tokens; a null text has none.

        Arrow splits the texts and numbers their distinct chunks; Python sees each of those once.
        """
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.chunker.odd).to_numpy(zero_copy_only=False)
        words = pc.ascii_split_whitespace(pc.utf8_lower(texts.filter(pa.array(~odd))))
        coded = words.flatten().dictionary_encode()
        found = pa.array(self.lookup(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.concatenate([[0], np.cumsum(pc.binary_length(found).to_numpy())])[words.offsets.to_numpy() - words.offsets[0].as_py()]
        data = b"".join([found.buffers()[2] or b""]) if len(found) else b""
        out, k = [], 0
        for text, strange in zip(texts, odd, strict=True):
            if strange:
                own = list(self.chunker.parts(text.as_py()))
                distinct = list({c for chunks, _ in own for c in chunks})
                at = dict(zip(distinct, self.lookup(distinct), strict=True))
                out.append(b"".join(b"".join(map(at.__getitem__, chunks)) + (b"" if i is None else i.to_bytes(4, "little")) for chunks, i in own))
            else:
                out.append(data[ends[k] : ends[k + 1]])
                k += 1
        return out


class PrefixCounts(dict):
    """Chunk -> its number of tokens, by dynamic programming over prefixes.

    `inner[i]` is the last token of the encoding of a word's first i characters while the word goes on, the one token
    that ends there, is its own encoding, and stands next to the last token of what is before it without a merge
    across the border; a word's end is the same choice among tokens with the end suffix. Each choice needs only
    tokens already chosen for shorter prefixes, so one pass gives the exact count at every prefix. Words that begin
    alike share the choices of their first `shared` prefixes; beyond, a word's choices are two arrays by place, so a word takes
    memory in proportion to its length.
    """

    shared = 24

    def __init__(self, path: str, bound: int = 500_000):
        self.chunker, self.bound = Chunker(path), bound
        model = self.chunker.spec["model"]
        suffix = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.rank = {a + b: k for k, (a, b) in enumerate(merges)}
        self.rule = {(a, b): k for k, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in merges}
        self.suffix = suffix
        self.vocab = model["vocab"]
        inner = [t for t in self.vocab if not (suffix and t.endswith(suffix))]
        self.inner = {t: t for t in inner}
        self.final = {t[: len(t) - len(suffix)]: t for t in self.vocab if t.endswith(suffix)} if suffix else {t: t for t in inner}
        self.longest = max(map(len, [*self.inner, *self.final]), default=1)
        self.spines: tuple[dict, dict] = {}, {}
        self.whole: dict[str, bool] = {}
        self.state: dict[str, tuple[str, int]] = {}
        self._split = self.chunker.tokenizer.pre_tokenizer.pre_tokenize_str

    def words(self, chunk: str) -> list[str]:
        """The chunk's words, each byte as one character of the vocabulary's alphabet."""
        return [as_bytes(chunk)] if _LETTERS.fullmatch(chunk) else [w for w, _ in self._split(chunk)]

    def _spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """The token, its left (side 0) or right (side 1) part, that part's part, and so on.

        Each with the rank of the merge that makes it and of the one that uses it up (past all ranks: none).
        """
        if (known := self.spines[side].get(token)) is None:
            known, part, used = [], token, len(self.rank)
            while True:
                made = self.rank.get(part, -1)
                known.append((part, made, used))
                if made < 0:
                    break
                part, used = self.halves[part][side], made
            self.spines[side][token] = known
        return known

    def _meet(self, a: str, b: str) -> bool:
        """No merge joins a part of a with a part of b before both are complete.

        Parts x at a's right edge and y at b's left edge stand side by side from when the later of them is made until
        the first of them is used up; their merge would come first if its rank lies in that time. Between equal
        ranks the leftmost place goes first: a's own merge before the border, the border before b's.
        """
        right, rule = self._spine(b, 0), self.rule.get
        for x, x_made, x_used in self._spine(a, 1):
            for y, y_made, y_used in right:
                r = rule((x, y))
                if r is not None and x_made < r < x_used and y_made < r <= y_used:
                    return False
        return True

    def _own(self, token: str) -> bool:
        """The token's string is encoded as the token itself."""
        if (known := self.whole.get(token)) is None:
            known = token not in self.halves or (all(map(self._own, self.halves[token])) and self._builds(token))
            self.whole[token] = known
        return known

    def _builds(self, token: str) -> bool:
        body = token[: len(token) - len(self.suffix)] if self.suffix and token.endswith(self.suffix) else token
        parts = list(body)
        if body is not token and body != token:
            parts[-1] += self.suffix
        while len(parts) > 1:
            ranks = [self.rule.get(p, len(self.rank)) for p in pairwise(parts)]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == len(self.rank):
                return False
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0] == token

    def _last(self, word: str, i: int, tokens: dict[str, str], last: list[str], count: array) -> tuple[str, int]:
        """The last token and the number of tokens of the first i characters, from those of shorter prefixes."""
        own = self.whole
        for k in range(max(0, i - self.longest), i):
            token = tokens.get(word[k:i])
            if token is not None and (own.get(token) or self._own(token)) and (not k or self._meet(last[k], token)):
                return token, count[k] + 1
        raise ValueError(f"no token ends at {i} in {word[:100]!r}")

    def _states(self, word: str, stop: int) -> tuple[list[str], array]:
        """The last token and the number of tokens by place below stop, while the word goes on."""
        last, count, state = [""], array("q", [0]), self.state
        if len(state) > 300_000:
            state.clear()
        for i in range(1, stop):
            if i > self.shared:
                token, n = self._last(word, i, self.inner, last, count)
            else:
                known = state.get(head := word[:i])
                if known is None:
                    known = state[head] = self._last(word, i, self.inner, last, count)
                token, n = known
            last.append(token)
            count.append(n)
        return last, count

    def prefixes(self, word: str) -> list[int]:
        """The number of tokens of each prefix of the word, from one character on, as if the text ended there."""
        last, count = self._states(word, len(word) + (not self.suffix))
        if not self.suffix:
            return count.tolist()[1:]
        return [self._last(word, i, self.final, last, count)[1] for i in range(1, len(word) + 1)]

    def _count(self, word: str) -> int:
        last, count = self._states(word, len(word) + (not self.suffix))
        return self._last(word, len(word), self.final, last, count)[1] if self.suffix else count[-1]

    def fitting(self, chunk: str, left: int) -> int:
        """How many of the chunk's first characters have at most `left` tokens.

        Runs and words that fit are passed whole; inside the first that doesn't, the longest prefix that fits is found
        in its prefix counts.
        """
        at = 0
        for run in self.chunker.runs(chunk) or [chunk]:
            if (n := self[run]) > left:
                chunk = run
                break
            left, at = left - n, at + len(run)
        else:
            return at
        for word in self.words(chunk):
            if (n := self._count(word)) <= left:
                left, at = left - n, at + len(_as_text(word))
                continue
            raw = word.translate(_UNBYTES).encode("latin-1") if not word.isascii() else word.encode()
            fits = [i for i, n in enumerate(self.prefixes(word), 1) if n <= left and (i == len(raw) or raw[i] & 0xC0 != 0x80)]
            return at + (len(raw[: fits[-1]].decode()) if fits else 0)
        return at

    def __missing__(self, chunk: str) -> int:
        if len(self) > self.bound:
            self.clear()
        runs = self.chunker.runs(chunk)
        if runs is None or len(runs) == 1:
            n = sum(map(self._count, self.words(chunk)))
        else:  # its runs may be chunks elsewhere
            n = sum(map(self.__getitem__, runs))
        if len(chunk) <= _LONG:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        return sum(sum(map(self.__getitem__, chunks)) + (special is not None) for chunks, special in self.chunker.parts(text))

    def cumulative(self, text: str) -> tuple[np.ndarray, list[str]]:
        """Tokens up to and with each chunk, and the chunks; a special token counts as a chunk of its own."""
        names, counts = [], []
        special = {i: s for s, i in self.chunker.special.items()}
        for chunks, i in self.chunker.parts(text):
            names += chunks
            counts += map(self.__getitem__, chunks)
            if i is not None:
                names.append(special[i])
                counts.append(1)
        return np.cumsum(np.array(counts, np.int64)), names
