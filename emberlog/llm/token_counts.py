"""Edit-aware token counts: a tree over a text's pre-tokens, of which an edit re-encodes only what it touches.

A text is cut into pre-tokens by the tokenizer's pattern. Runs of ``LEAF`` pre-tokens are leaves; a complete binary
tree above them holds, for every node, the code points and the tokens below it. An edit descends by code points to the
first leaf whose cut can change (the pattern looks ahead, but never back), cuts the new text from that leaf's start
until a cut falls on an old leaf's start again, and encodes only that stretch. The stretch becomes the first touched
leaf, the other touched leaves become empty, and only sums on the paths above them are recomputed. A leaf that has
grown beyond ``4 * LEAF`` pre-tokens makes the tree be laid out anew, which those insertions have paid for.

``plant`` gives every document its tree, as arrays of its leaves; ``edit`` takes that table and edits, makes each tree
from its stored leaves without encoding anything, and gives back a table of the same form, for the next edits.

Defined results: null or empty texts have 0 tokens; an edit with a null or negative position, or one past the end,
is moved into the text; null lengths and insertions count as 0 and ""; null edits and null arrays of edits change
nothing. Repeated rows are counted each for itself, null ids stay null, an empty table gives an empty one, and other
columns of the documents are there for the expression of the edits only.
"""
from __future__ import annotations

import base64
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices

LEAF = 32
#: Most pre-tokens whose counts are remembered in a Python worker.
REMEMBERED = 300_000
#: The pattern reads at most so many code points beyond a pre-token's end before it decides where that end is.
LOOKAHEAD = 3


class Counter(dict):
    """Tokens of a pre-token, remembered."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(public_tokenizers.PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < REMEMBERED:
            self[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


class TokenTree:
    """The tree of one text. ``chars`` and ``tokens`` are heaps: node i has the children 2i and 2i + 1.

    leaves: code points and tokens of each, as ``leaves`` has given them for this text; nothing is encoded then.
    """

    def __init__(self, text: str, count: Counter, leaves: tuple[list[int], list[int]] | None = None):
        self.count, self.text, self.encoded = count, text, 0
        if leaves is None:
            self._lay_out(text)
        else:
            self._grow(*leaves)

    def _grow(self, chars: list[int], tokens: list[int]) -> None:
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for heap in (self.chars, self.tokens):
            for i in range(self.size - 1, 0, -1):
                heap[i] = heap[2 * i] + heap[2 * i + 1]

    def leaves(self) -> tuple[list[int], list[int]]:
        return self.chars[self.size :], self.tokens[self.size :]

    def _lay_out(self, text: str) -> None:
        pieces = self.count.cut.findall(text)
        self.text, self.encoded = text, self.encoded + len(text)
        get = self.count.__getitem__
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        self._grow([sum(map(len, x)) for x in leaves], [sum(map(get, x)) for x in leaves])

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds the code point at a position, and where the leaf starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if position >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def edit(self, position: int, removed: int, inserted: str) -> None:
        """Replaces ``removed`` code points at a position."""
        position = max(0, min(position, len(self.text)))
        end = min(len(self.text), position + max(0, removed))
        text = self.text[:position] + inserted + self.text[end:]
        first, start = self._leaf_at(max(0, position - LOOKAHEAD))
        while start > 0 and start + LOOKAHEAD >= position:  # a cut this near could move, too
            first, start = self._leaf_at(start - 1)
        # the first leaf holds the stretch, so it can end only where a later one starts
        shift, leaf, old_start = len(text) - len(self.text), first + 1, start + self.chars[self.size + first]
        tokens, pieces, at = 0, 0, start
        get = self.count.__getitem__
        for m in self.count.cut.finditer(text, start):
            while leaf < self.size and old_start + shift < m.start():  # the old leaf starts, as the new text has them
                old_start += self.chars[self.size + leaf]
                leaf += 1
            if leaf < self.size and old_start >= end and old_start + shift == m.start():
                break
            tokens, pieces, at = tokens + get(m.group()), pieces + 1, m.end()
        else:
            leaf = self.size
        self.text, self.encoded = text, self.encoded + at - start
        if pieces > 4 * LEAF:
            self._lay_out(text)
            return
        for i in range(first, leaf):
            mine = i == first
            self.chars[self.size + i], self.tokens[self.size + i] = (at - start) * mine, tokens * mine
        low, high = (self.size + first) // 2, (self.size + leaf - 1) // 2
        while low:
            for i in range(low, high + 1):
                for heap in (self.chars, self.tokens):
                    heap[i] = heap[2 * i] + heap[2 * i + 1]
            low, high = low // 2, high // 2


TREES = pa.schema([("id", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("tree_chars", pa.list_(pa.int32())), ("tree_tokens", pa.list_(pa.int32()))])
TREE_FIELDS = "id long, text string, n_tokens long, tree_chars array<int>, tree_tokens array<int>"
#: What an expression of edits gives: a place in code points, how many of them go, what comes in.
EDIT_TYPE = "array<struct<position:int,removed:int,inserted:string>>"
EDITED = pa.schema([*TREES, ("n_tokens_before", pa.int64()), ("n_edits", pa.int64()), ("encoded_chars", pa.int64())])
EDITED_FIELDS = TREE_FIELDS + ", n_tokens_before long, n_edits long, encoded_chars long"


def plant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """id, text, n_tokens, tree_chars, tree_tokens (code points and tokens of the tree's leaves): a row per document.

    ``edits``, an SQL expression over the columns of ``docs``, adds a column of that name for ``edit``.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")
    schema, fields = TREES, TREE_FIELDS
    taken = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.expr(edits).cast(EDIT_TYPE).alias("edits")] if edits else []))
    if edits:
        schema, fields = pa.schema([*TREES, ("edits", pa.list_(pa.struct([("position", pa.int32()), ("removed", pa.int32()), ("inserted", pa.string())])))]), f"{TREE_FIELDS}, edits {EDIT_TYPE}"

    def run(rows: dict[str, list]) -> dict[str, list]:
        trees = [TokenTree(text or "", counter(path)) for text in rows["text"]]
        leaves = [t.leaves() for t in trees]
        return rows | {"n_tokens": [t.n_tokens for t in trees], "tree_chars": [c for c, _ in leaves], "tree_tokens": [n for _, n in leaves]}

    return taken.mapInArrow(by_slices(run, schema), fields)


def edit(trees: DataFrame, edits: str = "edits", tokenizer: str | None = None) -> DataFrame:
    """The trees after their edits, with n_tokens_before, n_edits and encoded_chars (how much was encoded for it).

    ``edits`` is an SQL expression over the columns of ``trees``: an array of structs (position, removed, inserted),
    applied in order.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(rows: dict[str, list]) -> dict[str, list]:
        made: dict[str, list] = {x: [] for x in EDITED.names}
        for key, text, before, changes, *leaves in zip(*(rows[x] for x in ("id", "text", "n_tokens", "edits", "tree_chars", "tree_tokens"))):
            tree = TokenTree(text or "", counter(path), tuple(leaves))
            changes = [e for e in changes or () if e is not None]
            for e in changes:
                tree.edit(e["position"] or 0, e["removed"] or 0, e["inserted"] or "")
            for name, v in zip(EDITED.names, (key, tree.text if changes else text, tree.n_tokens, *tree.leaves(), before, len(changes), tree.encoded)):
                made[name].append(v)
        return made

    return trees.select("id", "text", "n_tokens", "tree_chars", "tree_tokens", F.expr(edits).cast(EDIT_TYPE).alias("edits")).mapInArrow(by_slices(run, EDITED), EDITED_FIELDS)
