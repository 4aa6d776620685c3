"""Token counts under a unigram model by dynamic programming over a trie.

A text is cut into pre-tokens (a run of white space's last space joins the word
after it).  A pre-token's best segmentation maximises the sum of its pieces' scores;
forward scores depend on the prefix alone.  So the distinct pre-tokens of a batch are
inserted in a trie, whose nodes hold the forward score and the number of pieces of
their prefix: each is scored once, when it is made, however many pre-tokens share
it.  Nodes at which a pre-token ends are terminal, and their counts are kept by
pre-token, so each distinct pre-token is scored once in a task.  The trie of a batch
is let go after it, the counts while they are few.  The trie is ``DEPTH`` deep: of a
longer pre-token the rest is scored on from its node without being stored, so
memory is bounded.

Vocabulary: the ranks of a public byte-level tokenizer (nothing is trained).  A
piece's score is minus its code length under Zipf's law, ``-log(rank + 10)``;
all 256 single bytes are pieces, so every text can be segmented.  Ties go to the
fewer pieces.

Defined cases: null and empty texts have no pre-tokens and no tokens; a pre-token of
any length is a path of the trie; rows that repeat an id are counted one by one; an
empty table gives an empty table; further columns are left out.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRE_TOKEN = re.compile(rb" ?[^\s]+|\s+?(?= [^\s])|\s+")
HELD = 1 << 18
DEPTH = 1024


def load_scores(path: str) -> dict[bytes, float]:
    """Scores of the pieces of a file of base64 pieces and ranks."""
    scores = {}
    with open(path, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            scores[base64.b64decode(piece)] = -math.log(int(rank) + 10)
    return scores


class Counter:
    """Number of pieces of pre-tokens; keeps what it has counted."""

    def __init__(self, scores: dict[bytes, float]):
        self.longest = max(map(len, scores), default=1)
        # pieces by their last byte, reversed, as nested maps: walking back from the
        # end of a prefix meets every piece that ends there
        self.ends: dict = {}
        for piece, score in scores.items():
            node = self.ends
            for byte in reversed(piece):
                node = node.setdefault(byte, {})
            node[-1] = score
        self.known: dict[bytes, int] = {}
        self.grow()

    def insert(self, word: bytes) -> int:
        """Number of pieces of a word, which is put into the trie.

        ``best`` and ``pieces`` are the forward scores and counts of its prefixes, of
        which only those within a piece's length are looked at again.
        """
        node, depth = 0, 0
        best, pieces = [self.best[0]], [self.pieces[0]]
        for byte in word[:DEPTH]:  # as far as the trie has it
            below = self.children.get(node << 8 | byte)
            if below is None:
                break
            node, depth = below, depth + 1
            best.append(self.best[node])
            pieces.append(self.pieces[node])
        gone = 0  # prefixes forgotten
        for end in range(depth + 1, len(word) + 1):
            ends, top, count, start = self.ends, -math.inf, 0, end
            while start:
                ends = ends.get(word[start - 1])
                if ends is None:
                    break
                start -= 1
                score = ends.get(-1)
                if score is not None:
                    total = best[start - gone] + score
                    if total > top or (total == top and pieces[start - gone] + 1 < count):
                        top, count = total, pieces[start - gone] + 1
            best.append(top)
            pieces.append(count)
            if end <= DEPTH:
                self.children[node << 8 | word[end - 1]] = node = len(self.best)
                self.best.append(top)
                self.pieces.append(count)
            elif len(best) > 4096 + self.longest:
                gone += 4096
                del best[:4096], pieces[:4096]
        return pieces[-1]

    def grow(self) -> None:
        """Begin a new trie: its root only."""
        self.children: dict[int, int] = {}  # by node and byte
        self.best, self.pieces = [0.0], [0]

    def learn(self, words: Iterable[bytes]) -> None:
        """Count new pre-tokens by a trie of them."""
        if len(self.known) > HELD:
            self.known.clear()
        self.grow()
        for word in set(words) - self.known.keys():
            self.known[word] = self.insert(word)

    def count(self, text: bytes) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = PRE_TOKEN.findall(text)
        missing = [w for w in words if w not in self.known]
        if missing:
            self.learn(words)
        return len(words), sum(map(self.known.__getitem__, words))


def count_tokens(
    docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_pretokens`` and ``n_tokens``; no exchange.

    The vocabulary is read on the driver and broadcast (its size is that of the file).
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_scores(ranks_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            for k in range(0, len(texts), 256):
                counter.learn(w for t in texts[k : k + 256] for w in PRE_TOKEN.findall(t))
                found = [counter.count(t) for t in texts[k : k + 256]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(k, 256),
                        pa.array([len(t) for t in texts[k : k + 256]], pa.int64()),
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.int64()),
                    ],
                    names=[id_col, "n_bytes", "n_pretokens", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), text_col).mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_pretokens long, n_tokens long"
    )
