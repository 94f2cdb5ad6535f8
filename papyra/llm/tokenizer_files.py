"""Merge lists of two public tokenizer files, read once by each Python worker.

Paths are parameters. A path must be readable where the task runs (installed with the
workers, or shipped with ``spark.files``); no vocabulary is kept in this repository.
"""

from __future__ import annotations

import json

from .automaton import BEGIN, PrefixMachine, TokenAutomaton
from .common import resident

#: States of the byte-level automaton that a worker keeps: some 65,000 serve 26 MB of mixed text, and a smaller table is compiled over and over.
STATES = 150_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = (chr(256 + i) for i in range(256))
    return {b: chr(b) if b in printable else next(spare) for b in range(256)}


class ByteLevelBpe:
    """A byte-level BPE file of the ``tokenizers`` library as an automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: another normaliser or pre-tokenizer than byte-level words without a prefix space, which this codec doesn't follow")
        vocab = spec["model"]["vocab"]
        of_char = {c: b for b, c in byte_alphabet().items()}
        merges = []
        for m in spec["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((vocab[a], vocab[b], vocab[a + b]))
        made = {m[2] for m in merges}
        spelled = {i: tuple(of_char[c] for c in s) for s, i in vocab.items() if all(c in of_char for c in s)}
        #: Strings that are cut out of a text before anything else, with their ids.
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.automaton = TokenAutomaton(size, merges, [i for i in spelled if i not in made])
        self.machine = PrefixMachine(self.automaton, spelled, counted=False, max_states=STATES)
        #: The bytes that decoding emits for each id: the label of its arcs.
        self.label = [b""] * size
        for i, s in spelled.items():
            self.label[i] = bytes(s)
        for s, i in self.added.items():
            self.label[i] = s.encode()

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """Walk the table over the word, then read the tokens from its end to its start."""
        last, out, i = self.machine.labels(word), [], len(word)
        while i:
            out.append(last[i - 1])
            i -= len(self.label[last[i - 1]])
        return tuple(reversed(out))


class PieceCounter:
    """A sentencepiece BPE model with byte fallback as a transducer that emits token counts."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # What the transducer takes for granted: a space mark before the text, and texts as they are.
        if model.encode("a", out_type=str) != ["▁a"] or model.decode(model.encode("ﬁ  Ａ é ")) != "ﬁ  Ａ é ":
            raise ValueError(f"{path}: another normaliser or no leading space mark, which this transducer doesn't follow")
        n = model.get_piece_size()
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        piece = {i: model.id_to_piece(i) for i in usable}
        score = {i: model.get_score(i) for i in usable}
        of_piece = {p: i for i, p in piece.items()}
        # Equal scores are told apart by length: the only ties are runs of the space mark.
        order = sorted((i for i in usable if len(piece[i]) > 1), key=lambda i: (-score[i], len(piece[i]), i))
        rank = {i: k for k, i in enumerate(order)}
        merges = []
        for i in order:
            halves = last_merge(piece[i], of_piece, rank)
            if halves:
                merges.append((of_piece[halves[0]], of_piece[halves[1]], i))
        self.characters = frozenset(p for p in of_piece if len(p) == 1)
        automaton = TokenAutomaton(n, merges, [i for i in usable if len(piece[i]) == 1])
        spelled = {i: tuple(piece[i]) for i in usable if automaton.made[i] != -2}
        if any("▁" in p.lstrip("▁") for p in piece.values()):
            raise ValueError("a piece holds a space mark after another character: words aren't independent")
        self.machine = PrefixMachine(automaton, spelled, counted=True)

    def run(self, live: tuple, word: str) -> tuple[tuple, int]:
        """The state after a stretch of a word that no token's end lies before, and the tokens that it adds."""
        total, known, inside = 0, self.characters, []
        for c in word:
            if c in known:
                inside.append(c)
            else:  # falls back to one token a byte, which nothing merges with
                if inside:
                    total += self.machine.run(live, inside)[1]
                    inside = []
                live = BEGIN
                total += len(c.encode("utf-8", "surrogatepass"))
        if inside:
            live, n = self.machine.run(live, inside)
            total += n
        return live, total

    def count_word(self, word: str) -> int:
        """Tokens of a stretch that starts and ends where no token can cross."""
        return self.run(BEGIN, word)[1]


def last_merge(piece: str, of_piece: dict[str, int], rank: dict[int, int]) -> tuple[str, str] | None:
    """The two parts that encoding a piece's own text joins last; None if encoding never makes it."""
    parts = list(piece)
    if any(c not in of_piece for c in parts):
        return None
    while len(parts) > 2:
        best = min(((rank[j], k) for k in range(len(parts) - 1) if (j := of_piece.get(parts[k] + parts[k + 1])) in rank), default=None)
        if best is None:
            return None
        k = best[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 1:
            return None
    return (parts[0], parts[1])


def byte_level(path: str) -> ByteLevelBpe:
    return resident(("byte-level", path), lambda: ByteLevelBpe(path))


def piece_counter(path: str) -> PieceCounter:
    return resident(("pieces", path), lambda: PieceCounter(path))
