"""Ids of the word BPE, as its own tokenizer gives them, at a multiple of its speed.

The tokenizer lower-cases, cuts at white space and between letters, single digits and other signs, and joins bytes up to
a word end, so ids depend on one blank-separated word at a time. The distinct words of a slice of texts are encoded
together: as one string with a mark after each word, which is lower-cased, cut and encoded once, by the same vocabulary
as byte ranks, where a NUL byte stands for the word end. Their ids are then taken for every word of the texts. That
equals the tokenizer for ordinary Latin, Greek and Cyrillic words; words with anything else, or with the text of a
special token, go to the tokenizer itself. Nothing is remembered from one slice to the next.
"""
from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from tokenizers import Tokenizer

#: Stands after each word that is learned; words that hold it themselves are odd.
MARK = "\x01"
#: The tokenizer's own cut, for words that are not odd, and the mark.
CUT = rf"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w{MARK}]|_)+|{MARK}"
#: Control characters, the capital sigma (its lower case depends on its place), combining marks, signs that are numbers
#: but no digits, and scripts beyond Cyrillic.
ODD = "[\x00-\x1f\x7f-\xa0\xb2\xb3\xb9\xbc-\xbe\u03a3\u0300-\u036f\u0483-\u0489\u0530-\U0010ffff]"
END = "</w>"


def _byte_symbols() -> dict[str, int]:
    """The printable character for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, merges = data["model"]["vocab"], data["model"]["merges"]
        symbols = _byte_symbols()

        def plain(token: str) -> bytes:
            ended = token.endswith(END)
            return bytes(symbols[c] for c in (token[: -len(END)] if ended else token)) + b"\0" * ended

        tokens = list(symbols) + [c + END for c, b in symbols.items() if b] + ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in merges]
        # the order is the priority of joining: single bytes, a byte with the word end, then the merges
        ranks: dict[bytes, int] = {}
        ids = []
        for t in tokens:
            if (b := plain(t)) not in ranks:
                ranks[b] = len(ids)
                ids.append(vocab[t])
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        self.ids = np.array(ids, "<u4")
        self.mark = ranks[MARK.encode() + b"\0"]
        self.cut = re.compile(CUT)
        self.odd = "|".join([ODD, *(re.escape(x["content"]) for x in data["added_tokens"])])

    def _ids_of(self, words: pa.StringArray) -> pa.ListArray:
        """A list of ids for each word."""
        odd = pc.match_substring_regex(words, self.odd).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", words) if odd.any() else words
        text = pc.binary_join(pa.ListArray.from_arrays([0, len(plain)], plain), MARK)[0].as_py() + MARK
        ranks = self.encoding.encode_to_numpy("\0".join(self.cut.findall(unicodedata.normalize("NFC", text).lower())) + "\0")
        marks = ranks == self.mark
        ids, stops = self.ids[ranks[~marks]], np.cumsum(~marks)[marks]
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(ids))
        if not odd.any():
            return lists
        own = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words.filter(pa.array(odd)).to_pylist()]
        place = np.where(odd, len(words) - 1 + np.cumsum(odd), np.arange(len(words)))
        return pa.concat_arrays([lists, pa.array(own, lists.type)]).take(pa.array(place))

    def encode(self, texts: pa.StringArray | list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(texts)
        coded = words.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        ids = self._ids_of(coded.dictionary).take(coded.indices)
        data, stops = ids.flatten().to_numpy().tobytes(), (4 * ids.offsets.to_numpy()[words.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:])]
