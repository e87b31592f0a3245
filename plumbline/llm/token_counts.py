"""Word-piece token counts by a linear longest-match automaton (operator 1).

The vocabulary is a trie whose nodes carry a failure link and the number of tokens that following the link completes
("popped"). One pass over the characters of a word then gives the length of its greedy longest-match segmentation; no
piece is ever cut out or looked up.

Definition. A word is a run of characters other than [\\x20\\x09-\\x0D]; it is matched as the word mark U+2581 followed by
the word. At each place the longest vocabulary piece is taken; a code point at which no piece starts counts as its
UTF-8 bytes (byte fallback). Null, empty and blank texts have 0 words and 0 tokens. Texts are read whole; every row
stays, repeated rows and null ids included; columns of the output's names are replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import append_columns, binary_column

WORD_MARK = "▁"
#: Words whose counts a task remembers; beyond it the memory starts anew, so that its size is bounded.
MEMO_WORDS = 400_000


class LongestMatch:
    """Trie with failure links and popped-token counts."""

    def __init__(self, pieces: Iterable[str]):
        self.step: dict[int, int] = {}
        token, first, parents = [False], [""], [(0, 0)]
        children: list[list[int]] = [[]]
        for piece in pieces:
            node = 0
            for ch in piece:
                key = node << 21 | ord(ch)
                nxt = self.step.get(key)
                if nxt is None:
                    nxt = self.step[key] = len(token)
                    token.append(False)
                    first.append(ch)
                    parents.append((node, ord(ch)))
                    children.append([])
                    children[node].append(nxt)
                node = nxt
            if node:
                token[node] = True
        self.link, self.popped = [0] * len(token), [0] * len(token)
        level = children[0]
        for v in level:
            self.popped[v] = 1 if token[v] else len(first[v].encode("utf-8", "surrogatepass"))
        while level := [w for v in level for w in children[v]]:
            for v in level:
                if token[v]:
                    self.popped[v] = 1
                    continue
                u, c = parents[v]
                count, z = self.popped[u], self.link[u]
                while (nxt := self.step.get(z << 21 | c)) is None and z:
                    count += self.popped[z]
                    z = self.link[z]
                if nxt is None:  # no piece starts with this character
                    count, nxt = count + len(chr(c).encode("utf-8", "surrogatepass")), 0
                self.link[v], self.popped[v] = nxt, count

    def count(self, word: str) -> int:
        step, link, popped, node, total = self.step, self.link, self.popped, 0, 0
        for ch in word:
            c = ord(ch)
            while (nxt := step.get(node << 21 | c)) is None and node:
                total += popped[node]
                node = link[node]
            if nxt is None:
                total += 1 if c < 128 else len(ch.encode("utf-8", "surrogatepass"))
                node = 0
            else:
                node = nxt
        while node:
            total += popped[node]
            node = link[node]
        return total


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.automaton.count(WORD_MARK + word.decode("utf-8", "replace"))
        return n


_built: dict[str, LongestMatch] = {}


def _automaton(key: str, pieces) -> LongestMatch:
    if key not in _built:
        _built.clear()
        _built[key] = LongestMatch(pieces.value)
    return _built[key]


def sentencepiece_vocabulary(path: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


def token_counts(df: DataFrame, vocabulary: list[str], text_col: str = "text", words_col: str = "n_words", tokens_col: str = "n_tokens") -> DataFrame:
    """Add the numbers of words and of greedy word pieces of each text.

    The vocabulary (its size is the tokenizer's, whatever the data) is broadcast; each worker builds the automaton once.
    One pass over the rows without a shuffle.
    """
    key = hashlib.sha256("\n".join(vocabulary).encode()).hexdigest()
    pieces = df.sparkSession.sparkContext.broadcast(list(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]):
        memo = _Memo(_automaton(key, pieces))
        for batch in batches:
            n_words, n_tokens = [], []
            for text in binary_column(batch, text_col):
                words = text.split() if text else []
                n_words.append(len(words))
                n_tokens.append(sum(map(memo.__getitem__, words)))
                if len(memo) > MEMO_WORDS:
                    memo.clear()
            yield batch, [n_words, n_tokens]

    return append_columns(df, [T.StructField(words_col, T.LongType()), T.StructField(tokens_col, T.LongType())], run)
