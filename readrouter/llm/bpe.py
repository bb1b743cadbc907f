"""Byte-level BPE through a distinct-word table.

A word is what stands between single spaces, with the space before it; pieces of the tokenizer never reach over such a
boundary. Texts are split in Spark into blocks of whole documents; a block is its distinct words and, for each document, the
positions as codes of words. The words go to the partition of their hash, where each distinct word is encoded once for the whole
corpus; the ids come back to the block and take the places of the codes. Decoding joins ids with the vocabulary's pieces,
a table of fixed size.

Words and codes travel packed, one row for each block and hash partition, as a row for each word would multiply the
shuffle. A block holds at most about BLOCK_CHARS characters, or one document.

Defined results: null text counts as empty and has no ids; a space beside other white space
belongs to its word and parts nothing; the special token's string is that token, as in the library;
repeated rows are encoded each.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import importable, map_arrow, partitions

BLOCK_CHARS = 8_000_000
#: Distinct words a worker remembers before it starts anew (where no table is kept).
REMEMBERED = 200_000
#: A space that parts two words.
BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_loaded: dict[str, object] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file, one to a process and without threads of its own."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.no_truncation()
        loaded.no_padding()
        _loaded[path] = loaded
    return _loaded[path]


def merger(path: str):
    """A faster encoder of the same merges, or None where the file isn't byte-level BPE with ids in the order of the merges."""
    key = f"merger:{path}"
    if key not in _loaded:
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        model, kind = parsed["model"], (parsed.get("pre_tokenizer") or {})
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        plain = not parsed.get("normalizer") and kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        ordered = all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and sorted(model["vocab"].values()) == list(range(256 + len(merges)))
        _loaded[key] = None
        if model["type"] == "BPE" and plain and ordered and not model.get("ignore_merges"):
            import public_tokenizers
            import tiktoken

            letter = byte_letters()
            ranks = {bytes(letter[c] for c in word): i for word, i in model["vocab"].items()}
            _loaded[key] = tiktoken.Encoding(key, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """Ids of each word as little-endian unsigned 32-bit integers."""
    fast, specials = merger(path), special_tokens(path)
    if fast is None or any(s in w for w in words for s in specials):
        return [array("I", e.ids).tobytes() for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)]
    encode = fast.encode_ordinary
    return [array("I", encode(w)).tobytes() for w in words]


def special_tokens(path: str) -> tuple[str, ...]:
    key = f"specials:{path}"
    if key not in _loaded:
        _loaded[key] = tuple(t.content for t in tokenizer(path).get_added_tokens_decoder().values())
    return _loaded[key]


def byte_letters() -> dict[str, int]:
    """The byte for which each character of a byte-level vocabulary stands."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}


def words_of(text: str) -> list[str]:
    """The text's words; joined again they are the text."""
    if not text:
        return []
    first, *rest = text.split(" ")
    if rest and (not first or first[-1].isspace() or any(not w or w[0].isspace() or w[-1].isspace() for w in rest)):
        first, *rest = BETWEEN.split(text)
    return [first, *(" " + word for word in rest)]


class Encoder:
    """Whole texts to ids, remembering the words it has met lately."""

    def __init__(self, path: str):
        self.path = path
        #: By word without the space before it; None where a space beside it doesn't part words. Two generations, so that frequent words stay.
        self.known: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        again = words & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        words = words - again
        plain = [w for w in words if w and not w[0].isspace() and not w[-1].isspace()]
        self.known.update(dict.fromkeys(words))
        self.known.update(zip(plain, encode_words(self.path, [" " + w for w in plain])))

    def many(self, texts: list[str | None]):
        """The ids of each text; some texts at a time are held as words."""
        held, size = [], 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= 500_000:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held)

    def _some(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        rest = set().union(*(x[1:] for x in split))
        if len(self.known) > REMEMBERED:
            self.learn(rest)
        else:
            self.learn(rest - self.known.keys())
        heads = encode_words(self.path, [x[0] for x in split])
        out, get = [], self.known.get
        for text, words, head in zip(texts, split, heads):
            ids = list(map(get, words[1:]))
            if ids and (None in ids or not words[0] or words[0][-1].isspace()):
                out.append(b"".join(encode_words(self.path, words_of(text))))
            else:
                out.append(head + b"".join(ids))
        return out


def encoder(path: str) -> Encoder:
    """The worker's own encoder; it outlives a task."""
    key = f"encoder:{path}"
    if key not in _loaded:
        _loaded[key] = Encoder(path)
    return _loaded[key]


# The packed forms.


def _pack(data: bytes) -> bytes:
    return zstandard.compress(data, 3)


def _pack_numbers(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses small numbers well."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _blocks(batches):
    """(name, ids, texts) of whole documents in order; the name is the same whenever the partition is read again."""
    part, n = TaskContext.get().partitionId(), 0
    ids, texts, chars = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc_id)
            texts.append(text or "")
            chars += len(texts[-1])
            if chars >= BLOCK_CHARS:
                yield f"{part}-{n}", ids, texts
                ids, texts, chars, n = [], [], 0, n + 1
    if ids:
        yield f"{part}-{n}", ids, texts


def _coded(texts: list[str], parts: int):
    """Words by falling frequency, the part each goes to, the codes of all texts and the codes' number in each text."""
    known: dict[str, int] = {}
    codes, lengths = [], []
    for text in texts:
        words = words_of(text)
        lengths.append(len(words))
        codes.extend([known.setdefault(w, len(known)) for w in words])
    codes = np.array(codes, np.int64)
    order = np.argsort(-np.bincount(codes, minlength=len(known)), kind="stable")
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    names = list(known)
    words = [names[i].encode("utf-8", "surrogatepass") for i in order]
    part = np.array([zlib.crc32(w) % parts for w in words], np.uint32)
    return words, part, rank[codes], lengths


def _send_words(batches, parts):
    for name, _, texts in _blocks(batches):
        words, part, _, _ = _coded(texts, parts)
        mark = zlib.crc32(b"\0".join(words))
        for p in np.unique(part):
            own = [words[i] for i in np.flatnonzero(part == p)]
            packed = _pack(np.array(list(map(len, own)), "<u4").tobytes() + b"".join(own))
            yield pa.RecordBatch.from_pydict({"block": [name], "part": pa.array([p], pa.int32()), "n": pa.array([len(own)], pa.int64()), "mark": pa.array([mark], pa.int64()), "packed": [packed]})


def _send_codes(batches, parts):
    for name, ids, texts in _blocks(batches):
        words, part, codes, lengths = _coded(texts, parts)
        mark = zlib.crc32(b"\0".join(words))
        yield pa.RecordBatch.from_pydict({"block": [name], "mark": pa.array([mark], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int32())), "parts": [_pack_numbers(part)], "codes": [_pack_numbers(codes)]})


def _encode_distinct(batches, path):
    """Each distinct word of the partition is encoded once; the answer has the ids in the order of the words asked."""
    known: dict[bytes, bytes] = {}
    for batch in batches:
        for block, part, n, mark, packed in zip(*(c.to_pylist() for c in batch.columns)):
            data = zstandard.decompress(packed)
            ends = np.cumsum(np.frombuffer(data, "<u4", n)) + 4 * n
            at, words = 4 * n, []
            for end in ends.tolist():
                words.append(data[at:end])
                at = end
            new = [w for w in words if w not in known]
            known.update(zip(new, encode_words(path, [w.decode("utf-8", "surrogatepass") for w in new])))
            ids = [known[w] for w in words]
            sizes = np.array(list(map(len, ids)), "<u4") // 4
            out = _pack_numbers(np.concatenate([sizes, np.frombuffer(b"".join(ids), "<u4")]))
            yield pa.RecordBatch.from_pydict({"block": [block], "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "mark": pa.array([mark], pa.int64()), "packed": [out]})


def _join_back(codes: pa.Table, answers: pa.Table, finish, schema) -> pa.Table:
    """The ids of every document of one block, handed to finish(doc_ids, ids by code, codes by document)."""
    if not codes.num_rows:
        return schema.empty_table()
    if codes.num_rows != 1:
        raise ValueError("two blocks of one name: the documents were read in other partitions the second time")
    row = {k: v[0] for k, v in codes.to_pydict().items()}
    part, code = _unpack_numbers(row["parts"]), _unpack_numbers(row["codes"])
    by_code: list[bytes | None] = [None] * len(part)
    for p, n, mark, packed in zip(*(answers.column(c).to_pylist() for c in ("part", "n", "mark", "packed"))):
        places = np.flatnonzero(part == p)
        if mark != row["mark"] or n != len(places):
            raise ValueError("a block's words changed between two reads of the documents")
        numbers = _unpack_numbers(packed)
        data, ends = numbers[n:].tobytes(), np.cumsum(numbers[:n].astype(np.int64)) * 4
        at = 0
        for place, end in zip(places.tolist(), ends.tolist()):
            by_code[place] = data[at:end]
            at = end
    if None in by_code:
        raise ValueError("a block's words were not all encoded")
    return finish(row["doc_ids"], by_code, np.split(code, np.cumsum(row["lengths"])[:-1]))


def _with_ids(documents: DataFrame, path: str, finish, schema: pa.Schema, ddl: str) -> DataFrame:
    spark = documents.sparkSession
    importable(spark)
    parts = partitions(spark)
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    words = map_arrow(docs, partial(_send_words, parts=parts), "block string, part int, n bigint, mark bigint, packed binary")
    answers = map_arrow(words.repartition(parts, "part"), partial(_encode_distinct, path=path), "block string, part int, n bigint, mark bigint, packed binary")
    codes = map_arrow(docs, partial(_send_codes, parts=parts), "block string, mark bigint, doc_ids array<bigint>, lengths array<int>, parts binary, codes binary")
    join = partial(_join_back, finish=finish, schema=schema)
    return codes.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lambda a, b: join(a, b), ddl)


# What is made of the ids.


def _finish_ids(doc_ids, by_code, codes):
    ids = [np.frombuffer(b"".join([by_code[c] for c in x.tolist()]), "<u4").astype(np.int32) for x in codes]
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})


def encode(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _with_ids(documents, path or vocabulary_path(), _finish_ids, schema, "doc_id bigint, ids array<int>")


def pieces(path: str) -> list[bytes]:
    """The id-to-piece table: the bytes of every id."""
    key = f"pieces:{path}"
    if key not in _loaded:
        letter = byte_letters()
        vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
        added = set(special_tokens(path))
        table = [b""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            table[i] = word.encode() if word in added else bytes(letter[c] for c in word)
        _loaded[key] = table
    return _loaded[key]


def _decode(batches, path):
    table = pieces(path)
    for batch in batches:
        texts = [b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids; special tokens stay."""
    return map_arrow(encoded.select("doc_id", "ids"), partial(_decode, path=path or vocabulary_path()), "doc_id bigint, text string")


def _finish_digests(doc_ids, by_code, codes, path):
    table = pieces(path)
    decimal = [",".join(map(str, np.frombuffer(b, "<u4").tolist())).encode() for b in by_code]
    # The join of ids with pieces, once for each distinct word's ids.
    decoded = [b"".join([table[i] for i in np.frombuffer(b, "<u4").tolist()]) for b in by_code]
    size = [len(b) // 4 for b in by_code]
    out = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for doc_id, x in zip(doc_ids, codes):
        x = x.tolist()
        text = b"".join([decoded[c] for c in x])
        try:
            text.decode("utf-8")
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
        out["doc_id"].append(doc_id)
        out["n_tokens"].append(sum([size[c] for c in x]))
        out["ids_sha256"].append(hashlib.sha256(b",".join([decimal[c] for c in x])).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
    return pa.table({k: pa.array(v, pa.int64() if k in ("doc_id", "n_tokens") else pa.string()) for k, v in out.items()})


def round_trip(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The op4 contract: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or vocabulary_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _with_ids(documents, path, partial(_finish_digests, path=path), schema, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
