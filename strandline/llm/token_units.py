"""Library tokenizers applied to whole texts, with a cache of words inside each Python worker.

A text is cut before a space that follows a non-space.  Neither kind of
tokenizer served here lets a token reach over such a cut: the byte-level pattern
takes at most one space, in front of a word, and the word pattern drops white
space.  So the ids of a text are those of its words in order, and a word costs
one lookup in each chunk of texts that has it.  A text with a space after other
white space goes to the library whole.
"""

from __future__ import annotations

import re
import string
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a worker remembers (about 250 MB); beyond, it forgets the half that came last, as common words come early.
REMEMBERED = 1_200_000
#: Longer words hardly come again and are forgotten at once.
LONG = 24
#: Closing marks that no token joins with the letters before: those of ASCII but the apostrophe.
MARKS = string.punctuation.replace("'", "")
#: Letters that are their own normal form and lower case, so that a word of them is one token sequence anywhere.
PLAIN = string.ascii_lowercase + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
#: Plain words that go to the library as one text.
TOGETHER = 200
#: Characters that are cut and looked up at once.
CHUNK_CHARS = 1_000_000
#: The same for an encoder, which looks up each word of a chunk once.
ENCODER_CHARS = 4_000_000

_SPACE = frozenset(
    "\t\n\v\f\r \x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
)
_MARKS = frozenset(MARKS)
_PLAIN = re.compile(f"[{PLAIN}]+")
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_ENCODERS: dict[str, "Encoder"] = {}


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes.

    Words are remembered as they stand in texts.  A new word is put together from
    parts where the tokenizer cuts it anyhow: at a line feed between two
    non-spaces, and between letters and closing marks.  What is left is asked
    from the library, plain letters many words at a time.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        # Ids of space + word; None: a space after this word would follow white space.
        self._words: dict[str, bytes | None] = {}
        # Ids of a word without a space; the same where a space changes nothing.
        self._bare: dict[str, bytes | None] = self._words if self._whole([" a"]) == self._whole(["a"]) else {}
        self._feed = self._whole(["\n"])[0]
        upper, lower = self._whole(["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"])
        self._folds = upper == lower
        self._normalizes = self._tokenizer.normalizer is not None
        self._prepare_plain(path)

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(e.ids) for e in found]

    def _prepare_plain(self, path: str) -> None:
        """The tokenizer for plain words: without its normalizer, and with the simplest cut that gives the same."""
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        vocabulary = self._tokenizer.get_vocab()
        suffix = getattr(self._tokenizer.model, "end_of_word_suffix", None)
        # Tokens that end a word, or else those that begin one with its space.
        self._by_end = bool(suffix)
        self._edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self._edge[[i for t, i in vocabulary.items() if (t.endswith(suffix) if suffix else t.startswith("Ġ"))]] = True
        self._plain = self._tokenizer
        if self._words is self._bare:
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self._plain = Tokenizer.from_file(path)
            self._plain.normalizer = normalizers.Sequence([])
            self._plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), byte_level])
        probe = [*PLAIN, PLAIN, PLAIN[::-1], "the", "words", "naïve"]
        if self._together(probe) != self._whole([" " + w for w in probe]):
            self._plain = None

    def _together(self, words: list[str]) -> list[bytes] | None:
        """Ids of space + each plain word; None if the words can't be told apart in what the library gives."""
        texts = [" " + " ".join(words[i : i + TOGETHER]) for i in range(0, len(words), TOGETHER)]
        raw = b"".join(_packed(e.ids) for e in self._plain.encode_batch_fast(texts, add_special_tokens=False))
        edges = np.flatnonzero(self._edge[np.frombuffer(raw, "<u4")])
        stops = (4 * edges + 4).tolist() if self._by_end else [*(4 * edges[1:]).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(words) else None

    def _ask(self, before: str, words: list[str]) -> list[bytes]:
        """Ids of ``before`` + word from the library."""
        if self._plain is None or not (before or self._words is self._bare):
            return self._whole([before + w for w in words])
        plain = [bool(_PLAIN.fullmatch(w)) for w in words]
        many = [w for w, p in zip(words, plain) if p]
        found = self._together(many) if many else []
        if found is None:
            return self._whole([before + w for w in words])
        found, other = iter(found), iter(self._whole([before + w for w, p in zip(words, plain) if not p]))
        return [next(found) if p else next(other) for p in plain]

    def _core(self, word: str) -> str | None:
        """The letters before closing marks, if the tokenizer cuts there."""
        letters = word.rstrip(MARKS)
        if not letters or not 0 < len(word) - len(letters) <= LONG:
            return None
        if self._normalizes and not letters.isascii():  # a normalized letter may end in a combining mark
            return letters if unicodedata.normalize("NFC", letters).lower().isalpha() else None
        return letters if letters.isalpha() else None

    def _learn(self, words: dict[str, bytes | None], before: str, new: set[str]) -> list[str]:
        """Remember the ids of ``before`` + word without line feed; returns the words not worth keeping."""
        bare, need, parts = self._bare, set(), []
        for w in new:
            if not w or w[-1] in _SPACE:
                words[w] = None
            elif w[-1] in _MARKS and (core := self._core(w)) is not None:
                parts.append((w, core, w[len(core) :]))
                if core not in words:
                    need.add(core)
            else:
                need.add(w)
        tails = list({t for _, _, t in parts if t not in bare})
        bare.update(zip(tails, self._whole(tails)))
        upper = []
        if self._folds:
            low = {w: w.lower() for w in need if w.isascii() or _LATIN.fullmatch(w)}
            upper = [(w, x) for w, x in low.items() if w != x]
            need = {low.get(w, w) for w in need}
            need = {w for w in need if w not in words}
        need = list(need)
        words.update(zip(need, self._ask(before, need)))
        for w, x in upper:
            words[w] = words[x]
        for w, core, tail in parts:  # letters before what ends in a mark
            words[w] = words[core] + bare[tail]
        return [w for w in need if len(w) > LONG]

    def _learn_lines(self, new: list[str]) -> list[str]:
        """Remember the ids of space + words with line feeds inside."""
        words, bare = self._words, self._bare
        whole, lines = [], {}
        for w in new:
            cut = w.split("\n")
            if any(not x or x[0] in _SPACE or x[-1] in _SPACE for x in cut):
                whole.append(w)
            else:
                lines[w] = cut
        rare = self._learn(words, " ", {c[0] for c in lines.values() if c[0] not in words})
        self._learn(bare, "", {x for c in lines.values() for x in c[1:] if x not in bare})
        words.update(zip(whole, self._whole([" " + w for w in whole])))
        for w, cut in lines.items():
            words[w] = self._feed.join([words[cut[0]], *[bare[x] for x in cut[1:]]])
        return rare + new

    def _found(self, distinct: list[str]) -> tuple[list[bytes | None], list[str]]:
        """Ids of space + word for each, None where a space may not follow; and the words not worth keeping."""
        words = self._words
        found = list(map(words.get, distinct))
        places = [i for i, ids in enumerate(found) if ids is None]
        new = {w for i in places if (w := distinct[i]) not in words}
        feeds = [w for w in new if "\n" in w]
        new.difference_update(feeds)
        rare = self._learn(words, " ", new) + self._learn_lines(feeds)
        for i in places:
            found[i] = words[distinct[i]]
        return found, rare

    def _heads(self, heads: list[str], alone: list[bool]) -> list[bytes | None]:
        """Ids of the first words of texts, None where a space may not follow."""
        bare = self._bare
        odd = {h for h in heads if not h or "\n" in h or h[-1] in _SPACE}
        self._learn(bare, "", {h for h in heads if h not in odd and h not in bare})
        first = dict(zip(odd, self._whole(list(odd))))
        return [
            None if h and h[-1] in _SPACE and not a else first[h] if h in odd else bare[h] for h, a in zip(heads, alone)
        ]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        for cache in (self._words, self._bare):
            if len(cache) > REMEMBERED:
                for w in list(islice(reversed(cache), REMEMBERED // 2)):
                    del cache[w]
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()  # one lookup for each distinct word
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = coded.indices.to_numpy().astype(np.int64)
        bounds = cut.offsets.to_numpy()
        first = bounds[:-1]
        heads = self._heads([distinct[i] for i in at[first].tolist()], (np.diff(bounds) == 1).tolist())
        at[first] = len(distinct) + np.arange(len(texts))
        # Words that only begin texts are not looked up.
        used = np.bincount(at, minlength=len(distinct) + len(texts)) > 0
        places = np.flatnonzero(used[: len(distinct)])
        ids, rare = self._found([distinct[i] for i in places.tolist()])
        place = np.concatenate([np.cumsum(used[: len(distinct)]) - 1, len(places) + np.arange(len(texts))])
        at = place[at]
        found = pa.array(ids + heads, pa.large_binary())
        taken = found.take(pa.array(at))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[bounds].tolist()
        raw = memoryview(taken.buffers()[2] or b"")
        out = [bytes(raw[a:b]) for a, b in zip(ends, ends[1:])]
        for w in rare:
            self._words.pop(w, None)
        if found.null_count:
            missing = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False)[at])
            whole = np.unique(np.searchsorted(bounds, missing, "right") - 1).tolist()
            for i, x in zip(whole, self._whole([texts[i] for i in whole])):
                out[i] = x
        return out


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
