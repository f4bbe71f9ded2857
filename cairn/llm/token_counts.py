"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with a second root for pieces inside words. Every node
has a failure link, the node where matching goes on when no child fits, and the
number of pieces that this step takes off the word; both are worked out before.
A word is then read once, character by character, without building its pieces.

A word is a run without white space. A word that can't be cut into pieces is one
unknown token. Pieces come from a sentencepiece model: a word begins with the
word mark, which is a piece of its own where no longer piece fits (digits, CJK);
inside a word every piece fits; byte and control pieces are left out.

Cases: null and empty texts have no tokens; very long words cost time in
proportion to their length and are never kept in the cache; the longest piece
wins, so there are no ties; rows that repeat a doc_id are counted each; an empty
table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame

from cairn.llm.shared import Memo, id_text, map_rows

#: Flag in a word's count for an unknown word; leaves 32 bits for a text's tokens.
UNKNOWN = 1 << 32


class LongestMatch:
    """Counts of greedy longest-match pieces; an empty initial piece is one that takes no character of the word."""

    def __init__(self, initial: set[str], inner: set[str]):
        self.child: dict[tuple[int, str], int] = {}
        self.fail: list[int] = [-1, -1]  # 0: start of a word, 1: inside a word
        self.pops: list[int] = [0, 0]
        ends, order = set(), []
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    if (node, c) not in self.child:
                        self.child[node, c] = len(self.fail)
                        order.append((len(self.fail), node, c))
                        self.fail.append(-1)
                        self.pops.append(0)
                    node = self.child[node, c]
                if piece:
                    ends.add(node)
                elif root == 0:
                    self.fail[0], self.pops[0] = 1, 1
        depth = {0: 0, 1: 0}
        for node, up, _ in order:  # parents come before children
            depth[node] = depth[up] + 1
        for node, up, c in sorted(order, key=lambda x: depth[x[0]]):
            if node in ends:
                self.fail[node], self.pops[node] = 1, 1
                continue
            at, pops = self.fail[up], self.pops[up]
            while at >= 0 and (at, c) not in self.child:
                pops += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.child[at, c], pops

    def count(self, word: str) -> int:
        """Number of pieces, or UNKNOWN + 1."""
        child, fail, pops, at, n = self.child, self.fail, self.pops, 0, 0
        for c in word:
            while (then := child.get((at, c))) is None:
                n += pops[at]
                at = fail[at]
                if at < 0:
                    return UNKNOWN + 1
            at = then
        while at != 1:
            n += pops[at]
            at = fail[at]
            if at < 0:
                return UNKNOWN + 1
        return n


@lru_cache(maxsize=2)
def automaton(model: str) -> LongestMatch:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return LongestMatch({p[1:] for p in pieces if p[0] == "▁"}, set(pieces))


def token_counts(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown (of n_tokens) of every whole text; model: a path that executors can read."""

    def make():
        memo = Memo(automaton(model).count)

        def step(x: dict) -> dict:
            words = [t.split() for t in x["text"]]
            sums = [sum(map(memo.__getitem__, w)) for w in words]
            return {"doc_id": x["doc_id"], "n_words": list(map(len, words)), "n_tokens": [s % UNKNOWN for s in sums], "n_unknown": [s // UNKNOWN for s in sums]}

        return step

    return map_rows(id_text(docs), make, "doc_id long, n_words long, n_tokens long, n_unknown long")
