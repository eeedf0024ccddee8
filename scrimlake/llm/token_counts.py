"""Token counts by a unigram model over a trie of pre-tokens.

Pre-tokens are the words of a text with a mark before them. Each worker keeps its distinct pre-tokens; the new
ones are laid out in order, which walks their trie depth first: what a pre-token shares with the one before it
is on the stack already, so the forward score of a prefix (of its best segmentation) is computed once. At the
end of a pre-token its count of pieces is stored, and a text's count is the sum over its words.

The vocabulary's pieces have no probabilities, so their ranks give them, by Zipf's law. A character that is no
piece costs one token for each of its UTF-8 bytes. Of segmentations that score alike the one of fewer tokens counts.
"""

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_KNOWN = 800_000


def unigram(path: str) -> dict[str, float]:
    """piece -> log probability; path: a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    kept = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    total = sum(1 / (rank + 2.7) for rank in range(len(kept)))
    return {piece: -math.log((rank + 2.7) * total) for rank, piece in enumerate(kept)}


class TrieCounts(dict):
    """pre-token (UTF-8 bytes of the word) -> tokens, for those learned."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.byte = min(scores.values(), default=0.0) - 5.0

    def learn(self, words: set[bytes]) -> None:
        scores, longest, byte = self.scores, self.longest, self.byte
        best, tokens, before = [0.0], [0], ""  # the stack: score and tokens of each prefix of the path
        for word in sorted(words):
            text = MARK + word.decode()
            shared = 0
            for a, b in zip(before, text):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], tokens[shared + 1 :]
            for end in range(shared + 1, len(text) + 1):
                size = len(text[end - 1].encode())
                top, n = best[end - 1] + size * byte, tokens[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = scores.get(text[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and tokens[start] + 1 < n:
                            top, n = score, tokens[start] + 1
                best.append(top)
                tokens.append(n)
            before = text
            self[word] = tokens[-1]


@lru_cache(maxsize=1)
def _counts_of(path: str) -> TrieCounts:
    """Kept by the worker from task to task."""
    return TrieCounts(unigram(path))


def _count(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counts_of(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            n_words, n_tokens = [], []
            for at in range(0, len(texts), 500):
                split = [(t or b"").split() for t in texts[at : at + 500]]
                new = {w for ws in split for w in ws if w not in known}
                if len(known) + len(new) > _KNOWN:
                    known.clear()
                    new = {w for ws in split for w in ws}
                known.learn(new)
                n_words += map(len, split)
                n_tokens += [sum(map(known.__getitem__, ws)) for ws in split]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens of every row, without a shuffle.

    Null, empty and blank texts: 0. Repeated rows come out alike; a null id stays null; extra columns are ignored;
    an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(_count(path), "id long, n_words long, n_tokens long")
