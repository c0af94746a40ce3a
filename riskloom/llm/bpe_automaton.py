"""Byte-pair encoding as a deterministic automaton over tokens.

The automaton starts with one state in which every base symbol loops. The merges are then applied in order, each by a
gadget: for the merge of u and v into w, the state that u's arcs lead to is split, the new one keeps every arc but v's,
and wherever an arc u stood, an arc w is added that leads where v led before. What remains is the automaton of exactly the
token strings that the merges produce, so each word has one path whose labels spell it.

A split differs from its origin by a single missing arc, and an arc w stands where u stood when the gadget was applied.
So a state is kept as "the state of its right part when it was made, less what later gadgets took away", and whether an
arc exists is read off these tables once and then kept in the state's row of the transition table.
"""

from __future__ import annotations

#: Pairs kept in the transition table before it is filled anew.
KEPT_ARCS = 2_000_000
_NEVER = 1 << 60


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [chr(hidden.get(b, b)) for b in range(256)]


class MergeAutomaton:
    """``vocab``: token to id; ``merges``: pairs in order; ``word_end``: suffix of a word's last symbol."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str = ""):
        self.labels = [""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            self.labels[i] = token
        self.word_end = word_end
        self.vocab = vocab
        self.taken: dict[tuple[int, int], int] = {}  # (u, v): the gadget that took arc v from the state behind u
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.made: dict[int, int] = {}  # token: its gadget; base symbols have none
        self.rows: dict[int, dict[int, bool]] = {}
        self.n_arcs = 0
        for time, (u, v) in enumerate(merges):
            self._add_gadget(vocab[u], vocab[v], vocab[u + v], time)
        self._build_trie()

    def _add_gadget(self, u: int, v: int, w: int, time: int) -> None:
        if (u, v) in self.taken or not self._arc(u, v, time):
            return  # no path has u before v any more: the merge never applies
        self.taken[u, v] = time
        self.left.setdefault(w, u)
        self.right.setdefault(w, v)
        self.made.setdefault(w, time)

    def _arc(self, token: int, nxt: int, time: int = _NEVER) -> bool:
        """Whether the state behind ``token`` has an arc ``nxt`` after the gadgets up to ``time``."""
        while True:
            state, until = token, time
            while True:
                if self.taken.get((state, nxt), _NEVER) <= until and (state, nxt) in self.taken:
                    return False
                if state not in self.made:
                    break
                until = min(until, self.made[state] - 1)  # the state of the right part before this gadget
                state = self.right[state]
            if nxt not in self.made:
                return True
            time = min(time, self.made[nxt])
            nxt = self.left[nxt]

    def _build_trie(self) -> None:
        """Labels by their symbols, so that the arcs that spell the text at a place are found in one walk."""
        end = self.word_end
        self.first: dict = {}
        base = {i for s in byte_labels() for t in (s, s + end) if (i := self.vocab.get(t)) is not None}
        for i in self.made.keys() | base:
            label = self.labels[i]
            symbols = list(label)
            if end and label.endswith(end):
                symbols = list(label[: -len(end)])
                symbols[-1] += end
            node = self.first
            for symbol in symbols:
                node = node.setdefault(symbol, {})
            node[0] = i

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-split word, given by its byte symbols. Symbols without a token are left out.

        The walk takes the longest label first and remembers places that led nowhere: of all label
        sequences that spell the word the automaton has just one.
        """
        symbols = list(word)
        if symbols:
            symbols[-1] += self.word_end
        if not self.first.keys() >= set(symbols):
            symbols = [s for s in symbols if s in self.first]
        n, first, rows = len(symbols), self.first, self.rows
        open_arcs: list[list[tuple[int, int]]] = []  # of each place on the path: arcs not yet refuted, the one taken last
        places: list[int] = []
        path: list[int] = [-1]
        place, dead = 0, set()
        while place < n:
            node, arcs = first, []
            for at in range(place, n):
                node = node.get(symbols[at])
                if node is None:
                    break
                if 0 in node:
                    arcs.append((node[0], at + 1))
            places.append(place)
            open_arcs.append(arcs)
            while True:
                state = path[-1]
                while arcs:
                    i, at = arcs[-1]
                    if at not in dead:
                        if state < 0:
                            break
                        row = rows.get(state)
                        if row is None:
                            row = rows[state] = {}
                        ok = row.get(i)
                        if ok is None:
                            ok = row[i] = self._arc(state, i)
                            self.n_arcs += 1
                        if ok:
                            break
                    arcs.pop()
                if arcs:
                    path.append(i)
                    place = at
                    break
                dead.add(places.pop())
                open_arcs.pop()
                path.pop()
                if not open_arcs:
                    raise ValueError(f"no path spells {word!r}")
                arcs = open_arcs[-1]
                arcs.pop()
        if self.n_arcs > KEPT_ARCS:
            self.rows, self.n_arcs = {}, 0
        return path[1:]

    def add_labels(self, labels: dict[int, str]) -> None:
        """Labels of special tokens, which no path holds but which decoding may meet."""
        self.labels += [""] * (max(labels, default=-1) + 1 - len(self.labels))
        for i, label in labels.items():
            self.labels[i] = label

    def decode(self, ids) -> str:
        """The labels of the arcs, with a space between (the vocabulary declares no decoder of its own)."""
        return " ".join(map(self.labels.__getitem__, ids))
