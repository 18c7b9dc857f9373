"""Token counts of whole texts with a byte-level BPE vocabulary.

Whole-token shortcut: once, on the driver, every string of the vocabulary is encoded alone; those that come back as
one token are the shortcut. A pre-token of a text that is in it counts 1 without any merging; only the rest is merged,
and remembered for the worker's later rows.

Null text counts as empty: no bytes, no tokens. Empty tables give empty results, repeated rows repeated results. The
special strings of the vocabulary (as <|endoftext|>) count as one token wherever they stand, as the library does by
default. Other columns of the input are passed through if asked for by name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's pattern of pre-tokens (fixed value of the public byte-level BPE).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: So many merged pre-tokens are remembered by a worker; then it starts anew.
REMEMBERED = 400_000
#: Texts above so many characters are read piece by piece instead of as one list of pre-tokens.
LONG_TEXT = 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in such vocabularies: printable bytes for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """What workers need: special strings, ranks of byte strings, and the strings that are one token by themselves."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        special = {x["content"] for x in spec["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        self.ranks = {bytes(letters[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        order = [self.ranks[bytes(letters[c] for c in a + b)] for a, b in merges]
        if order != sorted(order):
            raise ValueError("ids of this vocabulary don't follow its merges")
        # The proof: each string that is valid text goes through the library alone.
        library = Tokenizer.from_file(path)
        texts = []
        for raw in self.ranks:
            try:
                texts.append(raw.decode("utf-8"))
            except UnicodeDecodeError:
                continue
        encoded = library.encode_batch(texts, add_special_tokens=False)
        self.whole = frozenset(t for t, e in zip(texts, encoded, strict=True) if len(e.ids) == 1)


class _Costs(dict):
    """Tokens of a pre-token: 1 for whole tokens, else as merged, on first sight."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken

        super().__init__(dict.fromkeys(vocabulary.whole, 1))
        self.core = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})._core_bpe
        self.base, self.limit = vocabulary.whole, len(vocabulary.whole) + REMEMBERED

    def __missing__(self, piece: str) -> int:
        if len(self) > self.limit:
            self.clear()
            self.update(dict.fromkeys(self.base, 1))
        n = len(self.core.encode_single_piece(piece.encode("utf-8")))
        if len(piece) <= 64:
            self[piece] = n
        return n


def counter(vocabulary: Vocabulary):
    """A function from text to its number of tokens."""
    import regex

    find = regex.compile(PATTERN)
    costs = _Costs(vocabulary)
    cut = regex.compile("|".join(map(regex.escape, vocabulary.special))) if vocabulary.special else None

    def plain(text: str) -> int:
        if len(text) > LONG_TEXT:
            return sum(costs[m.group()] for m in find.finditer(text))
        return sum(map(costs.__getitem__, find.findall(text)))

    def count(text: str) -> int:
        if cut is None or not any(s in text for s in vocabulary.special):
            return plain(text)
        parts = cut.split(text)
        return len(parts) - 1 + sum(map(plain, parts))

    return count


def count_tokens(docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 1024) -> DataFrame:
    """keep columns, n_bytes, n_tokens and over_limit of every row of docs."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(vocabulary_path))
    kept = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary.value)
        for batch in batches:
            texts = batch.column(len(keep))
            tokens = [count(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.compute.cast(pa.compute.binary_length(texts), pa.int64()), pa.array(tokens, pa.int64())], [*keep, "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401  used by run()

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*kept.schema.fields[: len(keep)], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return kept.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
