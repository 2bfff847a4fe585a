"""Sum-of-squares packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm.common import NUMBER_ROWS, batches_of, cut

#: Tokens in a sequence, the id that ends a document, and the tokenizer's file.
CAPACITY, END, TOKENIZER = 2_048, 0, "word_bpe_49k.json"
#: Pieces that one packer places, at most; it leaves about one sequence that could be fuller.
GROUP = 20_000
#: Entries of a worker's tables from parts of texts to ids; a table is emptied when full.
CACHE = 400_000
#: How a tokenizer is built for which parts of texts can be encoded by themselves: fixed values of its file, but for vocabulary and merges.
FITS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    None,
    None,
    {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
]
#: What most parts between blanks look like: letters with signs before and after.
PLAIN = re.compile(r"([!-&(-/:-@\[-`{-~]*)([^\W\d_]*)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(rest.get(b, b)) for b in range(256)]


class Ids(dict):
    """Parts of texts to their ids, as little-endian 32-bit numbers; what is missing is encoded.

    The tokenizer drops white space and never joins across it, so parts between blanks can be encoded one by one, and
    as they repeat, mostly looked up. Of a part of Latin letters with signs around, letters and signs are tokens of
    their own that only need lower case, which goes straight to the merges; any other part takes the tokenizer's whole
    way. That holds for tokenizers built like FITS, of which fits() tells.
    """

    def __init__(self, whole):
        super().__init__({"": b""})
        self.whole = whole
        self.merges, self.runs, self.letters = self.whole.model, {"": b""}, byte_letters()

    def run(self, run: str) -> bytes:
        """Ids of letters alone or signs alone."""
        ids = self.runs.get(run)
        if ids is None:
            if len(self.runs) > CACHE:
                self.runs = {"": b""}
            shown = run if run.isascii() else "".join([self.letters[b] for b in run.encode()])
            ids = self.runs[run] = array("I", [t.id for t in self.merges.tokenize(shown)]).tobytes()
        return ids

    def __missing__(self, part: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
            self[""] = b""
        match = PLAIN.fullmatch(part)
        if match and (not match[2] or match[2].isalpha() and max(match[2]) < "\u0130"):
            ids = self.run(match[1]) + self.run(match[2].lower()) + self.run(match[3])
        else:
            ids = array("I", self.whole.encode(part, add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids


def fits(whole) -> bool:
    """Whether a tokenizer is built as Ids takes for granted: nothing is added to what a text gives, and all but the vocabulary is like FITS."""
    built = json.loads(whole.to_str())
    model = {k: v for k, v in built["model"].items() if k not in ("vocab", "merges")}
    return [built[k] for k in ("normalizer", "pre_tokenizer", "post_processor", "truncation")] + [model] == FITS


def tokenizer(name: str = TOKENIZER, special_tokens: bool = False) -> Callable[[str], np.ndarray]:
    """Text to ids, those of the tokenizer's own encode() without added special tokens.

    special_tokens: whether a special token's string in a text is that token, as encode() has it unless told otherwise,
    or ordinary text. Texts that hold such a string, and tokenizers that the short cuts don't fit, go the whole way.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(name))
    whole.encode_special_tokens = not special_tokens
    added = [t.content for t in whole.get_added_tokens_decoder().values()]
    if not fits(whole):
        return lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
    plain = Tokenizer.from_file(public_tokenizers.path(name))
    plain.encode_special_tokens = True
    known = Ids(plain)

    def encode(text: str) -> np.ndarray:
        if special_tokens and any(t in text for t in added):
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(known.__getitem__, text.replace("\n", " ").split(" "))), "<u4")

    return encode


def pieces(capacity: int, name: str, keep_ids: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(name, special_tokens=True)
        end = np.array([END], "<u4")
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                ids = np.concatenate([encode(text or ""), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    out.append((doc, k, start, len(part), zlib.crc32(part.tobytes()), *((part.astype(np.int64).tolist(),) if keep_ids else ())))
            frame = pd.DataFrame(out, columns=["id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
            yield frame.astype({"id": batch["id"].dtype})

    return run


def place(lengths: np.ndarray, capacity: int, plain: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset for each length, by sum of squares, the longest first.

    open_[g] is the number of open sequences with gap g. A piece goes where the sum of open_[g] ** 2 over all gaps
    becomes smallest: into one with gap g, which then has gap g - length (0: closed, not counted), or into a new one;
    of equal sums into the smallest gap. A new one competes always; without `plain`, which takes some
    sequences fewer (README has figures), once as many sequences are open as all lengths need at least, a new one is
    opened only for a piece that fits nowhere.
    """
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_ = np.zeros(capacity + 1, np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, least = 0, -(-int(lengths.sum()) // capacity)
    for at in np.argsort(-lengths, kind="stable"):
        size = int(lengths[at])
        # by how much the sum changes, halved: a sequence leaves gap g and enters gap g - size
        change = open_[: capacity - size + 1] - open_[size:] + 1.0
        change[0] = -open_[size] + 0.5
        change[open_[size:] == 0] = np.inf
        if plain or used < least or not np.isfinite(change).any():
            change[-1] = open_[capacity - size] + 0.5 if size < capacity else 0.0
        gap = size + int(change.argmin())
        if gap == capacity:
            number, used = used, used + 1
        else:
            number = waiting[gap].pop()
            open_[gap] -= 1
        sequence[at], offset[at] = number, capacity - gap
        if gap > size:
            waiting[gap - size].append(number)
            open_[gap - size] += 1
    return sequence, offset


def packer(capacity: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Packs one partition's pieces."""
        held = list(batches)
        if held:
            rows = pd.concat(held, ignore_index=True)
            sequence, offset = place(rows["length"].to_numpy(), capacity)
            yield rows.drop(columns="part").assign(sequence_id=(rows["part"].to_numpy(np.int64) << 32) + sequence, offset=offset)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, name: str = TOKENIZER, keep_ids: bool = False, group: int = GROUP) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if they are kept).

    A document is its text's ids, by the tokenizer's encode() without added special tokens, and an end id, so a null or empty text is one piece of one id. Documents longer than
    `capacity` are cut into pieces of that length, the last of which may be shorter. Pieces are dealt evenly, whatever
    their ids, to packers of at most `group`, about; a packer holds lengths, not texts (unless ids are kept). Rows that share an id, or have
    none, are documents of their own, told apart by sequence_id and offset. An empty table gives no rows; other columns
    are not read.
    """
    spark = docs.sparkSession
    batches_of(spark)
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    rows = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(pieces(capacity, name, keep_ids), schema))
    batches_of(spark, NUMBER_ROWS if not keep_ids else 512)
    packers = max(1, -(-rows.count() // group))
    dealt = rows.repartition(packers).withColumn("part", F.spark_partition_id())
    packed = dealt.mapInPandas(packer(capacity), schema + ", sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_col)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of every document goes."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
