"""Token counts of a unigram model by dynamic programming over a trie (operator 8).

The distinct pre-tokens of a chunk of texts, in order, are the paths of a trie: what a pre-token shares
with the one before it is their common prefix. The forward scores (best log-probability of each prefix and
the tokens it takes) are kept on the current path, so a shared prefix is scored once; the count at a
pre-token's last node is stored and every text sums the counts of its pre-tokens. Walked in order, the trie
is never held whole: its memory is one path and the terminal counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import batch_blocks
from .scratch import tidied

_MODELS: dict = {}


class Unigram:
    """Pieces with log-probabilities; the mark begins every pre-token. A character in no piece is spelt
    in bytes, a token each."""

    def __init__(self, pieces: Iterable[str], mark: str = "▁"):
        ranked = list(pieces)
        total = sum(1 / (k + 2) for k in range(len(ranked)))
        self.score = {p: math.log(1 / (k + 2) / total) for k, p in enumerate(ranked)}
        self.longest, self.mark = max(map(len, self.score), default=1), mark
        self.byte = math.log(1 / (len(ranked) + 2) / total) - 10

    @classmethod
    def of_file(cls, path: str) -> Unigram:
        """The pieces of a sentencepiece file with probabilities by Zipf's law over their rank in it."""
        if path not in _MODELS:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            usual = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
            _MODELS[path] = cls(sp.id_to_piece(i) for i in usual)
        return _MODELS[path]

    def counts(self, words: Iterable[str]) -> dict[str, int]:
        """Tokens of each distinct pre-token. Equal scores: fewer tokens."""
        score, longest, found = self.score.get, self.longest, {}
        best, tokens, path = [0.0], [0], ""
        for word in sorted(words):
            text = self.mark + word
            same, most = 0, min(len(path), len(text))
            while same < most and path[same] == text[same]:
                same += 1
            del best[same + 1 :], tokens[same + 1 :]
            for end in range(same + 1, len(text) + 1):
                top, count = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    s = score(text[start:end])
                    if s is not None:
                        s += best[start]
                        if s > top or s == top and tokens[start] + 1 < count:
                            top, count = s, tokens[start] + 1
                if score(text[end - 1]) is None:
                    n = len(text[end - 1].encode())
                    s = best[end - 1] + n * self.byte
                    if s > top:
                        top, count = s, tokens[end - 1] + n
                best.append(top)
                tokens.append(count)
            path = text
            found[word] = tokens[-1]
        return found


def count_tokens(docs: DataFrame, model: str, chunk_chars: int = 24_000_000) -> DataFrame:
    """doc_id, n_pretokens, n_tokens of every whole text, without a shuffle.

    Pre-tokens are runs of characters other than space, tab, line feed, vertical tab, form feed and carriage
    return. A null or empty text has 0 of both. Repeated rows and null doc_ids stay; other columns are not
    read. A chunk's trie, at most chunk_chars of text or one text, bounds the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, held, names, size = Unigram.of_file(model), [], {}, 0

        def done() -> pa.RecordBatch:
            counts = unigram.counts(w.decode() for w in names)
            at = {w: counts[w.decode()] for w in names}.__getitem__
            return pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in held], pa.int64()), "n_pretokens": pa.array([len(w) for _, w in held], pa.int64()), "n_tokens": pa.array([sum(map(at, w)) for _, w in held], pa.int64())})

        for batch in (x for b in batches for x in batch_blocks(b, rows=2_000)):
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append((d, [names.setdefault(w, w) for w in (t or "").encode().split()]))
                size += len(t or "")
            if size >= chunk_chars:
                yield done()
                held, names, size = [], {}, 0
        if held:
            yield done()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(run), "doc_id long, n_pretokens long, n_tokens long")
