"""Token counts by a tokenizer compiled to a deterministic transducer."""
from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor

from .common import map_batches, texts_of

SPACE = "▁"
LIMIT = 4096
#: Characters after which a chunk ends at the next reset, and transitions a worker keeps before it starts anew.
CHUNK_CHARS = 1 << 15
MAX_TRANSITIONS = 900_000
#: A blank after anything but a blank: reading it leads every state to the same one.
RESET = re.compile(f"(?<=[^{SPACE}]){SPACE}")


class State(dict):
    """A transducer state: characters lead to (state, emitted tokens); transitions are made when first met."""

    __slots__ = ("key", "owner")

    def __missing__(self, char: str) -> tuple[State, int]:
        step = self[char] = self.owner.step(self.key, char)
        return step


class Transducer:
    """Counts the tokens of pair merging by one transition for each character.

    A sequence of tokens is the merge result exactly when each token is its own result and so is each pair of
    neighbours, so the result of a prefix is fixed by its last token and the result before it. A state therefore
    keeps, for each end of the prefix that can still begin a token, its place in the vocabulary trie, the token
    before it and how many tokens fewer there were. An emission is the change of the count and may be negative.
    A character that is no piece costs its UTF-8 bytes.
    """

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                       if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(RESET.search(p) for p in self.scores):
            raise ValueError("pieces go across word starts, so blanks do not reset the merges")
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[str] = [""]
        for piece in self.scores:
            node = 0
            for char in piece:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                    self.piece.append(self.piece[node] + char)
                node = self.children[node][char]
        self.pairs: dict[tuple[str, str], bool] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all states and pairs met so far; they are made again when needed."""
        self.pairs.clear()
        self.states: dict[tuple, State] = {}
        self.made = 0
        self.start = self.state(((0, "", 0),))

    def state(self, key: tuple) -> State:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.key, found.owner = key, self
        return found

    def merged(self, text: str) -> list[str]:
        """Merge result of a short text: always the neighbours whose joint piece scores highest, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            joins = [(-self.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores]
            if not joins:
                break
            i = min(joins)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def follows(self, before: str, token: str) -> bool:
        """Whether ``token`` stands by itself after ``before`` (empty: at the start or after a reset)."""
        known = self.pairs.get((before, token))
        if known is None:
            known = self.pairs[before, token] = self.merged(before + token) == ([before, token] if before else [token])
        return known

    def step(self, key: tuple, char: str) -> tuple[State, int]:
        self.made += 1
        token, count, live = None, 0, []
        for node, before, count_before in key:
            below = self.children[node].get(char)
            if below is None:
                if node:
                    continue
                candidate, cost = char, len(char.encode())
            else:
                candidate = self.piece[below]
                cost = 1 if candidate in self.scores else len(char.encode()) if not node else None
                if self.children[below]:
                    live.append((below, before, count_before))
            if token is None and cost is not None and self.follows("", candidate) and (not before or self.follows(before, candidate)):
                token, count = candidate, count_before + cost
        key = [(node, "" if self.piece[node][0] == SPACE and not before.endswith(SPACE) else before, c - count) for node, before, c in live]
        return self.state((*key, (0, token, 0))), count

    def chunks(self, text: str):
        """``text`` cut before resets into chunks of about CHUNK_CHARS; a run without one stays whole."""
        start = 0
        while len(text) - start > CHUNK_CHARS:
            cut = RESET.search(text, start + CHUNK_CHARS)
            if cut is None:
                break
            yield text[start:cut.start()]
            start = cut.start()
        yield text[start:]

    def run(self, chunk: str, state: State) -> tuple[State, int]:
        total = 0
        for char in chunk:
            state, n = state[char]
            total += n
        return state, total

    def count(self, text: str) -> int:
        """Tokens of a whole text: the composition of its chunks' maps.

        A chunk begins with a reset, so its map sends every state to one end state with one count, and the scan
        over maps is a sum; the first chunk starts with the blank that the tokenizer puts before a text.
        """
        if not text:
            return 0
        total = 0
        for chunk in self.chunks(SPACE + text.replace(" ", SPACE)):
            if self.made > MAX_TRANSITIONS:
                self.forget()
            total += self.run(chunk, self.start)[1]
        return total


@functools.lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every whole text.

    Null and empty texts have no bytes and no tokens. Rows are independent, repeats give repeats, other columns are
    ignored. The model file must be readable at ``path`` on every worker, where it is compiled as texts are read.
    """
    def work(batches):
        counter = transducer(path)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            tokens = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])
    return map_batches(texts_of(docs), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
