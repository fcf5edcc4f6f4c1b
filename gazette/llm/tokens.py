"""Token ids of public tokenizers, many texts at a time.

A byte-level vocabulary's texts go through tiktoken, built from the ranks of the tokenizers' own file: a third of the
time of the tokenizers library. A word-end vocabulary lets no token cross ASCII white space, so a step's texts are cut
there, each distinct chunk is normalised by the library's own normaliser and cut into words, each distinct word is merged
by tiktoken, and ids are gathered by number. Characters whose class the library sees otherwise than the patterns here
(it knows another version of Unicode) are found by asking it about each new character; chunks that hold one are cut by
the library's own pre-tokenizer. Tests hold the ids of every code point against the library's.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that are encoded together, where one text isn't longer, words that are merged as one text, and characters of a text that isn't held as a list of ids.
STEP_BYTES, JOINED, LIST_CHARS = 1 << 24, 512, 1 << 18

#: Fixed values of the vocabularies' files: the patterns of words, without and with the white space before them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value of the vocabularies' files: the mark of words' ends; and where such a last byte stands among characters.
END_MARK, FINAL = "</w>", 0x100
#: Marks that make a word of the patterns by themselves after letters.
PLAIN_MARKS = (",", ".", ";", ":", "!", "?", ")")
#: A control character that stands between chunks where they are normalised together, and a character that no word holds, as its bytes are written below FINAL + 256.
BORDER, MERGE_BORDER = "\x01", "\ue000"


class Distinct:
    """Ids of distinct chunks: chunk i has lengths[i] ids, from starts[i]."""

    def __init__(self, ids: list[np.ndarray], lengths: list[np.ndarray]):
        self.ids = np.concatenate([*ids, np.zeros(0, np.uint32)])
        self.lengths = np.concatenate([*lengths, np.zeros(0, np.int64)])
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gathered(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the chunks with these numbers, where each chunk's ids end)."""
        n = self.lengths[codes]
        ends = np.cumsum(n)
        return self.ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[codes] - ends + n, n)], ends


class Library:
    """A vocabulary's file as the tokenizers library reads it; the file's truncation and padding aren't used."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.size = self.tokenizer.get_vocab_size()
        self.specials = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        blank, blanks = self.tokenizer.encode_batch_fast(["a b", "a  b"], add_special_tokens=False)
        self.spaced = len(blank.ids) != len(blanks.ids)


class Words:
    """Chunks of a word-end vocabulary -> words, as the library's normaliser and pre-tokenizer make them."""

    def __init__(self, library: Library):
        self.library = library
        self.split = regex.compile(PATTERN).findall
        #: characters beyond ASCII that were asked about; those of another class in the library
        self.asked: set[str] = set()
        self.odd: set[str] = set()

    def _theirs(self, normal: str) -> list[str]:
        return [normal[b:e] for _, (b, e) in self.library.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def _ask(self, characters: set[str]) -> None:
        for c in characters:
            around = f"x{c}1{c}2({c}"
            theirs = self._theirs(around)
            if theirs != self.split(around) or c.isalpha() != (f"x{c}" in theirs):
                self.odd.add(c)
        self.asked |= characters

    def normalized(self, chunks: list[str]) -> list[str]:
        """Of chunks without BORDER. ASCII only needs its case lowered."""
        out = [c.lower() for c in chunks]
        others = [i for i, c in enumerate(chunks) if not c.isascii()]
        normal = self.library.tokenizer.normalizer.normalize_str
        for k in range(0, len(others), JOINED):
            some = others[k : k + JOINED]
            for i, c in zip(some, normal(BORDER.join([chunks[i] for i in some])).split(BORDER), strict=True):
                out[i] = c
        return out

    def _words(self, chunk: str) -> list[str]:
        """Letters alone, or with one mark after them, need no search."""
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in PLAIN_MARKS and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def _by_library(self, chunk: str) -> list[str]:
        """A special token is a word of its own: no other word holds both letters and marks."""
        out: list[str] = []
        for part in self.library.special.split(chunk):
            out += [part] if part in self.library.specials else self._theirs(self.library.tokenizer.normalizer.normalize_str(part))
        return out

    def of(self, chunks: list[str]) -> list[list[str]]:
        plain = [not (BORDER in c or "<|" in c) for c in chunks]
        normal = self.normalized([c if p else "" for c, p in zip(chunks, plain, strict=True)])
        characters = {c for c in set().union(*normal) if c > "\x7f"}
        self._ask(characters - self.asked)
        odd = "".join(map(re.escape, sorted(characters & self.odd)))
        holds_odd = re.compile(f"[{odd}]").search if odd else lambda _: None
        return [self._words(n) if p and not holds_odd(n) else self._by_library(c) for c, n, p in zip(chunks, normal, plain, strict=True)]


class Encoder(Library):
    """texts -> ids."""

    def __init__(self, path: str):
        super().__init__(path)
        self.words = None if self.spaced else Words(self)
        self.ranked, self.id_of, self.merge_border = self._by_rank()

    def _by_rank(self):
        """The vocabulary for tiktoken, and the id of each of its ranks.

        Each byte of a word is a character, the last byte of a word one of its own where the vocabulary marks ends of
        words. Characters of two bytes have the least ranks, so they are whole before any merge; merges follow in order.
        """
        import tiktoken

        byte_of = {c: b for b, c in enumerate(byte_characters())}
        marked = not self.spaced
        tokens = []
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token in self.specials:
                continue
            final = marked and token.endswith(END_MARK) and len(token) > len(END_MARK)
            symbols = [byte_of[c] for c in (token[: -len(END_MARK)] if final else token)]
            if final:
                symbols[-1] += FINAL
            tokens.append((len(symbols) > 1, i, "".join(map(chr, symbols)) if marked else bytes(symbols)))
        tokens.sort(key=lambda t: t[:2])
        texts = [t.encode("utf-8") if marked else t for _, _, t in tokens]
        lone = [bytes([b]) for b in range(256) if bytes([b]) not in set(texts)]  # halves of characters
        ranks = {t: r for r, t in enumerate([*lone, *texts])}
        border = max(self.specials.values(), default=self.size) + self.size
        special = self.specials | ({MERGE_BORDER: border} if marked else {})
        ids = np.array([0] * len(lone) + [i for _, i, _ in tokens] + list(special.values()), np.uint32)
        special = {s: len(ranks) + k for k, s in enumerate(special)}
        return tiktoken.Encoding("ranked", pat_str=r"[\s\S]+" if marked else SPACED_PATTERN, mergeable_ranks=ranks, special_tokens=special), ids, border

    def symbols(self, word: str) -> str:
        """The word's bytes as characters, the last one apart; a special token as it is."""
        if word in self.specials:
            return word
        raw = word.encode("utf-8")
        return raw[:-1].decode("latin-1") + chr(raw[-1] + FINAL)

    def of_words(self, words: list[str]) -> Distinct:
        """Words are merged as one text with a border between."""
        ids, lengths = [], []
        for i in range(0, len(words), JOINED):
            text = MERGE_BORDER.join(map(self.symbols, words[i : i + JOINED]))
            got = self.id_of[self.ranked.encode_to_numpy(text, allowed_special="all")]
            inner = got != self.merge_border
            lengths.append(np.diff(np.flatnonzero(~inner), prepend=-1, append=len(got)) - 1)
            ids.append(got[inner])
        return Distinct(ids, lengths)

    def of_chunks(self, chunks: list[str]) -> Distinct:
        """Of a word-end vocabulary's chunks."""
        split = self.words.of(chunks)
        distinct = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
        ids, ends = self.of_words(distinct.dictionary.to_pylist()).gathered(distinct.indices.to_numpy())
        return Distinct([ids], [np.diff(np.append(0, ends)[np.cumsum([0, *map(len, split)])])])

    def _spaced(self, text: str) -> np.ndarray:
        if len(text) > LIST_CHARS or "<|" in text:
            return self.id_of[self.ranked.encode_to_numpy(text, allowed_special="all")]
        return self.id_of[self.ranked.encode_ordinary(text)]

    def step(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each text's ids end)."""
        if self.spaced:
            ids = [self._spaced(t.as_py()) for t in texts]
            return np.concatenate([*ids, np.zeros(0, np.uint32)]), np.cumsum([len(x) for x in ids]).astype(np.int64)
        lists = pc.ascii_split_whitespace(texts)
        chunks = lists.flatten().dictionary_encode()
        ids, ends = self.of_chunks(chunks.dictionary.to_pylist()).gathered(chunks.indices.to_numpy())
        offsets = np.asarray(lists.offsets)
        return ids, np.append(0, ends)[offsets[1:] - offsets[0]]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each text's ids end) of one slice of texts after the other. Null: as an empty text."""
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + STEP_BYTES, "right")))
            yield self.step(texts.slice(begin, end - begin))
            begin = end


def with_end(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end id after each text."""
    ends = ends + np.arange(1, len(ends) + 1)
    out = np.full(len(ids) + len(ends), end_id, ids.dtype)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = ids
    return out, ends


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself if it is printable, else the next from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Where the vocabulary files of public tokenizers are."""
    import public_tokenizers

    return public_tokenizers.path(name)
