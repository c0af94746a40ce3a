"""Encoding of whole texts by the pieces between white space and the words in them, each encoded once and kept.

The vocabulary's normaliser and pre-tokenizer never join characters across white space or across words, so a text's ids
are those of its words in order. Words repeat, so a worker keeps the ids of what it has met, up to a bound.
"""

from __future__ import annotations

import json
import re
from array import array

from riskloom.llm.pieces import PieceTable
from riskloom.llm.shingles import groups_of

#: White_Space of Unicode, as the tokenizer's pattern has it (fixed values).
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0  -     　]+")
#: Beyond Latin letters a piece is normalised and split by the library itself.
_RARE = "ƀ"
#: Marks that the pre-tokenizer keeps together behind a word (an apostrophe could begin a contraction).
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Words kept by one worker before it starts anew, about 250 bytes each; the table of pieces has its own bound.
KEPT_WORDS = 250_000


class TextEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, special tokens of the text included.

    Subclasses give ``encode_words`` (words as normalised and pre-split) and ``encode_rare`` (a whole piece).
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.file = json.load(f)
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in self.file["added_tokens"]}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.find_words = regex.compile(self.file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.pieces = PieceTable()
        self.words: dict[str, bytes] = {}

    def encode_words(self, words: list[str]) -> list[bytes]:
        raise NotImplementedError

    def encode_rare(self, piece: str) -> bytes:
        raise NotImplementedError

    def __call__(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; about a megabyte of texts is looked up at once."""
        found: list[bytes] = []
        for a, b in groups_of(texts):
            found += self.pieces.encode([t.encode("utf-8", "surrogatepass") if t else b"" for t in texts[a:b]], self._learn)
        return found

    def _split(self, piece: str) -> list:
        """The piece's words as text, and ids of what is no plain word."""
        found: list = []
        for part in [p for p in self.cut_special.split(piece) if p] if "<|" in piece else [piece]:
            if part in self.special:
                found.append(self.special[part])
                continue
            for run in [r for r in _SPACE.split(part) if r]:  # white space beyond ASCII
                if run.isascii() or max(run) < _RARE:  # normalisation changes nothing here, and lower case needs no context
                    found += self.find_words(run.lower())
                else:
                    found.append(self.encode_rare(run))
        return found

    def _learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of new pieces."""
        words, split, wanted = self.words, [], set()
        for piece in pieces:
            core = piece.rstrip(_MARKS)
            tail, core = piece[len(core) :], core.lower()
            if core.isalpha() and (core.isascii() or max(piece) < _RARE):  # letters, then perhaps marks: two words at most
                found = [core, tail] if tail else [core]
            else:
                found = self._split(piece)
            split.append(found)
            wanted.update(found)
        wanted = {w for w in wanted if type(w) is str}
        new = list(wanted.difference(words))
        if len(words) + len(new) > KEPT_WORDS:
            words.clear()
            new = list(wanted)
        if new:
            words.update(zip(new, self.encode_words(new), strict=True))
        return [b"".join([words[w] if type(w) is str else w for w in found]) for found in split]


class LibraryEncoder(TextEncoder):
    """By the tokenizers library. New words go to it in one text; a token with the word-end suffix ends each."""

    def __init__(self, path: str):
        import os

        import numpy as np

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__(path)
        vocab = self.file["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(self.file["model"]["end_of_word_suffix"])]] = True

    def encode_words(self, words: list[str]) -> list[bytes]:
        import numpy as np

        ids = np.array(self.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def encode_rare(self, piece: str) -> bytes:
        return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()


class AutomatonEncoder(TextEncoder):
    """By the merge automaton; the library only normalises and splits rare scripts."""

    def __init__(self, path: str):
        from riskloom.llm.bpe_automaton import MergeAutomaton, byte_labels

        super().__init__(path)
        model = self.file["model"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], pairs, model["end_of_word_suffix"] or "")
        self.automaton.add_labels({t["id"]: t["content"] for t in self.file["added_tokens"]})
        self.byte_label = byte_labels()

    def encode_words(self, words: list[str]) -> list[bytes]:
        label, encode = self.byte_label, self.automaton.encode_word
        return [array("I", encode(w if w.isascii() and w.isprintable() else "".join([label[b] for b in w.encode()]))).tobytes() for w in words]

    def encode_rare(self, piece: str) -> bytes:
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
        return b"".join([array("I", self.automaton.encode_word(symbols)).tobytes() for symbols, _ in split])


_kept: dict[tuple[type, str], TextEncoder] = {}


def encoder(kind: type[TextEncoder], path: str) -> TextEncoder:
    """One encoder per worker process, kind and file."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]
