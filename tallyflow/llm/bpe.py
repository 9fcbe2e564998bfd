"""BPE encoding and decoding by dynamic programming over prefixes.

For byte-pair merges the last token of the encoding of a prefix is unique. ``PrefixWords``
finds it for every prefix of a word: an automaton over the vocabulary lists, through its suffix
links, the tokens that end at a position; the one that is compatible with the last token of
the prefix before it is stored. Back-pointers from the end of the word give the exact ids.
Two tokens are compatible when no merge joins symbols of both before their own merges are done.

Null and empty texts have no tokens. Each row gives one row, repeated rows too; further columns
of the input are not read. A very long text is encoded whole, in a batch of its own.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyflow.llm.encoding import BatchEncoder, id_column
from tallyflow.llm.texts import arrow_schema, kept_in_worker, slices, tokenizer_file

END = "\0"  # stands for the end-of-word suffix: one character that no byte maps to
NEVER = 1 << 62
KNOWN_PAIRS = 1_000_000  # memory bound of the pair tests kept


class PrefixWords:
    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix = model["end_of_word_suffix"]

        def plain(token: str) -> str:
            return token[: -len(suffix)] + END if token.endswith(suffix) and token != suffix else token

        ids = {plain(t): i for t, i in model["vocab"].items()}
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for n, (a, b) in enumerate(model["merges"]):
            left, right, whole = ids[plain(a)], ids[plain(b)], ids[plain(a + b)]
            self.joined[left, right] = n
            if whole not in self.rank:
                self.rank[whole], self.halves[whole] = n, (left, right)
        self.automaton = ahocorasick.Automaton()
        for text, i in ids.items():
            self.automaton.add_word(text, (i, len(text)))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(symbol, merge by which it arises, merge by which it is used up) along one edge of a token."""
        out, used = [], NEVER
        while True:
            born = self.rank.get(token, -1)
            out.append((token, born, used))
            if token not in self.halves:
                return out
            used, token = born, self.halves[token][side]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            known = True
            for x, x_born, x_used in self._edge(a, 1):
                for y, y_born, y_used in self._edge(b, 0):
                    n = self.joined.get((x, y))
                    # equal merges apply from the left: the symbol on the left is used up first
                    if n is not None and max(x_born, y_born) <= n < x_used and n <= y_used:
                        known = False
            if len(self.pairs) >= KNOWN_PAIRS:
                self.pairs.clear()
            self.pairs[a << 32 | b] = known
        return known

    def ids(self, word: str) -> list[int]:
        text = word + END
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)  # (token, start) of each prefix
        known = self.pairs.get
        for end, (token, length) in self.automaton.iter(text):
            if last[end + 1] is not None:
                continue
            start = end + 1 - length
            if start:
                before = last[start]
                if before is None:
                    continue
                fits = known(before[0] << 32 | token)
                if fits is None:
                    fits = self.compatible(before[0], token)
                if not fits:
                    continue
            last[end + 1] = (token, start)
        out, at = [], len(text)
        while at:
            if last[at] is None:
                raise ValueError(f"no encoding for {word!r}")
            token, at = last[at]
            out.append(token)
        return out[::-1]


def prefix_encoder(path: str | None = None) -> BatchEncoder:
    """The worker's encoder: what it keeps serves all tasks that the worker runs."""
    file = path or tokenizer_file()
    return kept_in_worker(("prefix", file), lambda: BatchEncoder(PrefixWords(file), file))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary, decoded string): little-endian unsigned 32-bit ids, and the text of these ids."""
    st, schema = arrow_schema(f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids binary, decoded string")

    def run(batches):
        encoder = prefix_encoder(path)
        for part in slices(batches, text_col):
            ids, offsets = encoder.encode(part.column(text_col))
            columns = [part.column(id_col), id_column(ids, offsets), encoder.decode(ids, offsets)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(id_col, text_col).mapInArrow(run, st)
