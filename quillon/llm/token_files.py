"""Token-ID output: documents as token ids in Arrow IPC files of equal-length sequences.

Layout of an output folder::

    part-00000.arrow        record batches of  ids   FixedSizeList<uint16 or uint32>[L]
                                               mask  Dictionary<FixedSizeList<uint8>[L]>  (1: real token)
    part-00000.index.arrow  doc_id, start (offset inside the part), n_tokens
    manifest.arrow          part, n_docs, n_tokens, n_sequences, in global order

Documents are packed one after another, each followed by the end id, in ascending doc_id
order over all parts, or in a given order; only the last sequence of a part is padded (mask 0).
Every sequence of a batch has the same length, so ids and mask of sequence ``i`` of a
memory-mapped part are zero-copy slices. All sequences but the last share one mask, so masks
are a dictionary: the full one, and where a part ends amid a sequence the one of its last. The number of documents a task holds is bounded by one Arrow batch; a part
is written under a temporary name and renamed, so a rerun of a lost task replaces it.
"""

from __future__ import annotations

import json
import os
import sys
import types
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm.common import remove_at_exit, shared_folder, trimmed

_SPACE = "[\\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Texts where a space touches other white space, or that begin or end with white space, are encoded whole.
IRREGULAR = f" {_SPACE}|{_SPACE} |^{_SPACE}|{_SPACE}$|^$"
MANIFEST = "part int, n_docs long, n_tokens long, n_sequences long"


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a folder named by URI or local path."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(uri))


def cuts_at_spaces(tokenizer: Tokenizer) -> bool:
    """Whether texts can be cut at spaces: plain byte-level BPE by its own pattern, nothing added, changed or dropped."""
    state = json.loads(tokenizer.to_str())
    model, pre = state["model"], state.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    untouched = not state.get("normalizer") and not state.get("truncation") and not state.get("padding")
    added = all(t.get("special") and " " not in t["content"] and not t.get("lstrip") and not t.get("rstrip") and not t.get("single_word") for t in state.get("added_tokens") or [])
    return bool(plain and byte_level and untouched and added)


class PieceEncoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    Byte-level BPE never joins text across a space between two visible characters: the space
    always starts a pre-token. So texts are cut there, each distinct piece is encoded once,
    many in one call (their ids are told apart by the tokens' byte lengths), and remembered
    up to a bound for as long as the worker process lives. Texts are encoded whole with any
    other tokenizer.
    """

    REMEMBER = 300_000  # in each of two generations

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        state = sys.modules.setdefault("_quillon_pieces", types.ModuleType("_quillon_pieces"))
        if path not in state.__dict__:
            tokenizer = Tokenizer.from_file(path)
            sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
            special = tokenizer.get_added_tokens_decoder()
            for token, i in tokenizer.get_vocab().items():  # byte-level: a character stands for a byte
                sizes[i] = len(token.encode()) if i in special else len(token)
            state.__dict__[path] = (tokenizer, sizes, {}, {}, cuts_at_spaces(tokenizer))
        self.tokenizer, self.sizes, self.known, self.older, self.cuts = state.__dict__[path]

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, words: list[str], lengths: np.ndarray) -> list[bytes]:
        """Ids of these words (of so many bytes) with a space before them, as bytes; remembered."""
        out: list[bytes] = []
        for i in range(0, len(words), 500):
            some = words[i : i + 500]
            (ids,) = self.whole([" " + " ".join(some)])
            ends = np.cumsum(lengths[i : i + 500] + 1)
            at = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1)).tolist()
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *at], at, strict=False)]
        self.known.update(zip(words, out, strict=True))
        return out

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        if not self.cuts:
            return self.whole(texts.to_pylist())
        odd = pc.match_substring_regex(texts, IRREGULAR)
        out: list = [None] * len(texts)
        if irregular := pc.indices_nonzero(odd).to_pylist():
            for i, ids in zip(irregular, self.whole(texts.take(irregular).to_pylist()), strict=True):
                out[i] = ids
        regular = pc.indices_nonzero(pc.invert(odd))
        if not len(regular):
            return out
        pieces = pc.split_pattern(texts.take(regular), " ")
        starts = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.known) > self.REMEMBER:  # the older generation goes, what is in use comes back from it
            self.older.clear()
            self.older.update(self.known)
            self.known.clear()
        data = list(map(self.known.get, words))
        new = []
        for i, d in enumerate(data):
            if d is None:
                if (d := self.older.get(words[i])) is None:
                    new.append(i)
                else:
                    data[i] = self.known[words[i]] = d
        if new:
            new.sort(key=words.__getitem__)  # neighbours share merges, which is faster to encode
            learnt = self.learn([words[i] for i in new], pc.binary_length(coded.dictionary).to_numpy()[new])
            for i, ids in zip(new, learnt, strict=True):
                data[i] = ids
        sizes = np.fromiter(map(len, data), np.int32, len(data)) // 4
        flat = np.frombuffer(b"".join(data), np.uint32)
        begins = np.cumsum(sizes, dtype=np.int32) - sizes
        firsts = self.whole(pc.list_element(pieces, 0).to_pylist())  # no space before the first piece
        places = regular.to_pylist()
        k = 0
        while k < len(places):  # blocks of texts with about 200,000 pieces, so that the gathered indices stay small
            end = max(k + 1, int(np.searchsorted(starts, starts[k] + 200_000)))
            end = min(end, len(places))
            block = codes[starts[k] : starts[end]]
            lengths = sizes[block]
            ends = np.cumsum(lengths, dtype=np.int64)
            ids = flat[np.repeat(begins[block] - (ends - lengths), lengths) + np.arange(ends[-1])]
            for j in range(k, end):
                a, b = starts[j] - starts[k], starts[j + 1] - starts[k]
                out[places[j]] = np.concatenate([firsts[j], ids[ends[a] : ends[b - 1]]])
            k = end
        return out


class PartWriter:
    """Packs documents into the sequences of one part."""

    def __init__(self, fs: pafs.FileSystem, folder: str, part: int, length: int, dtype: np.dtype, rows: int = 128) -> None:
        self.fs, self.length, self.dtype, self.rows, self.part = fs, length, dtype, rows, part
        kind = pa.from_numpy_dtype(dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])
        self.index_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        tag = uuid.uuid4().hex
        self.names = [(f"{folder}/.{part:05d}.{tag}{end}", f"{folder}/part-{part:05d}{end}") for end in (".arrow", ".index.arrow")]
        self.sinks = [fs.open_output_stream(a) for a, _ in self.names]
        # the mask of the last sequence is added to the dictionary when it is known
        self.data = pa.ipc.new_file(self.sinks[0], self.schema, options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.index = pa.ipc.new_file(self.sinks[1], self.index_schema)
        self.buffer, self.filled = np.zeros(rows * length, dtype), 0
        self.entries: list[tuple] = []
        self.n_docs = self.n_tokens = self.n_sequences = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.entries.append((doc_id, self.n_tokens, len(ids)))
        self.n_docs += 1
        self.n_tokens += len(ids)
        if len(self.entries) >= 20_000:
            self._index()
        while len(ids):
            n = min(len(ids), len(self.buffer) - self.filled)
            self.buffer[self.filled : self.filled + n] = ids[:n]
            self.filled, ids = self.filled + n, ids[n:]
            if self.filled == len(self.buffer):
                self._batch()

    def _index(self) -> None:
        columns = list(zip(*self.entries, strict=True)) or [(), (), ()]
        self.index.write_batch(pa.record_batch([pa.array(c, pa.int64()) for c in columns], schema=self.index_schema))
        self.entries = []

    def _batch(self) -> None:
        n = -(-self.filled // self.length)
        size = n * self.length
        self.buffer[self.filled : size] = 0
        masks, which = [np.ones(self.length, np.uint8)], np.zeros(n, np.int8)
        if self.filled < size:
            masks.append((np.arange(self.length) < self.filled - (n - 1) * self.length).astype(np.uint8))
            which[-1] = 1
        ids, values = (pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (self.buffer[:size].copy(), np.concatenate(masks)))
        self.data.write_batch(pa.record_batch([ids, pa.DictionaryArray.from_arrays(pa.array(which), values)], schema=self.schema))
        self.n_sequences += n
        self.filled = 0

    def close(self) -> tuple[int, int, int, int]:
        if self.filled:
            self._batch()
        if self.entries:
            self._index()
        for writer, sink in zip((self.data, self.index), self.sinks, strict=True):
            writer.close()
            sink.close()
        for temporary, final in self.names:
            self.fs.move(temporary, final)
        return self.part, self.n_docs, self.n_tokens, self.n_sequences


def slices(batch: pa.RecordBatch, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``size`` bytes of text (column 1), so that memory follows the longest text only."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size)))
        yield batch.slice(at, end - at)
        at = end


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, length: int = 1024, order: list[Column] | None = None) -> str:
    """Encode every whole text and write the folder described above; returns the folder.

    One range shuffle of (doc_id, text) gives the global order; ties in doc_id (repeated
    documents) are ordered by a hash of the text and then the text, so that many copies of
    one id still spread over tasks. Null ids come first; null and empty texts give just the
    end id; an empty table gives a folder with an empty manifest; extra columns are ignored.
    ``order`` (columns of docs that tell its rows apart) takes the place of the doc_id. The
    driver sees one small row per part.
    """
    spark = docs.sparkSession
    dtype = np.dtype(np.uint16 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32)
    fs, place = open_store(folder)
    fs.create_dir(place, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, writer = PieceEncoder(tokenizer_path), None
        store, path = open_store(folder)
        for batch in batches:
            for some in slices(batch):
                writer = writer or PartWriter(store, path, TaskContext.get().partitionId(), length, dtype)
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(some.column(1)), strict=True):
                    writer.add(doc_id, np.append(ids, end_id).astype(dtype))
        if writer:
            yield pa.record_batch([pa.array([x], t) for x, t in zip(writer.close(), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["part", "n_docs", "n_tokens", "n_sequences"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    keys = [c.alias(f"order{i}") for i, c in enumerate(order if order is not None else [doc_id, F.xxhash64(text)])]
    keyed = docs.select(doc_id.alias("doc_id"), text.alias("text"), *keys)
    names = [f"order{i}" for i in range(len(keys))]
    ordered = keyed.repartitionByRange(*names).sortWithinPartitions(*names, "text").select("doc_id", "text")
    parts = sorted(tuple(r) for r in ordered.mapInArrow(trimmed(write), MANIFEST).collect())
    columns = list(zip(*parts, strict=True)) or [(), (), (), ()]
    schema = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_sequences", pa.int64())])
    with fs.open_output_stream(f"{place}/manifest.arrow") as sink, pa.ipc.new_file(sink, schema) as out:
        out.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema))
    return folder


def open_part(fs: pafs.FileSystem, path: str) -> pa.ipc.RecordBatchFileReader:
    """A part for random access: memory-mapped where the store is local."""
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def read_sequence(folder: str, part: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of the i-th sequence of a part, without reading the others."""
    fs, place = open_store(folder)
    reader = open_part(fs, f"{place}/part-{part:05d}.arrow")
    rows = len(reader.get_batch(0))
    batch = reader.get_batch(i // rows)
    at, masks = i % rows, batch.column(1)
    values = masks.dictionary[masks.indices[at].as_py()].values
    return batch.column(0)[at].values.to_numpy(zero_copy_only=True), values.to_numpy(zero_copy_only=True)


def file_order(docs: DataFrame) -> list[Column]:
    """The order of the rows in the files of a frame that was read from Parquet: by name of file, then place."""
    return [docs["_metadata"]["file_path"], docs["_metadata"]["row_index"]]


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document read back from the files: doc_id, start, n_tokens, ids_crc32, n_masked.

    start counts the ids of all documents before it; ids_crc32 is the unsigned CRC-32 of the
    document's ids as little-endian unsigned 32-bit integers; n_masked counts its ids under
    the mask, equal to n_tokens.
    """
    fs, place = open_store(folder)
    with fs.open_input_file(f"{place}/manifest.arrow") as f:
        manifest = pa.ipc.open_file(f).read_all().to_pylist()
    rows, base = [], 0
    for m in manifest:
        rows.append((m["part"], base))
        base += m["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        for batch in batches:
            for part, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = open_part(store, f"{path}/part-{part:05d}.arrow")
                index = open_part(store, f"{path}/part-{part:05d}.index.arrow")
                at, k, ids, mask = 0, 0, np.zeros(0, np.uint32), np.zeros(0, np.uint8)
                for j in range(index.num_record_batches):
                    entries = index.get_batch(j)
                    crcs, masked = [], []
                    for n in entries.column(2).to_pylist():
                        crc = seen = 0
                        while n:
                            if at == len(ids):
                                got = data.get_batch(k)
                                masks = got.column(1)
                                length = masks.type.value_type.list_size
                                ids, mask = got.column(0).values.to_numpy(), masks.dictionary.values.to_numpy().reshape(-1, length)[masks.indices.to_numpy()].reshape(-1)
                                at, k = 0, k + 1
                            step = min(n, len(ids) - at)
                            crc = zlib.crc32(ids[at : at + step].astype("<u4").tobytes(), crc)
                            seen += int(mask[at : at + step].sum(dtype=np.int64))
                            at, n = at + step, n - step
                        crcs.append(crc)
                        masked.append(seen)
                    start = pa.array(entries.column(1).to_numpy() + before, pa.int64())
                    yield pa.record_batch([entries.column(0), start, entries.column(2), pa.array(crcs, pa.int64()), pa.array(masked, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "n_masked"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, n_masked long"
    if not rows:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame(rows, "part int, before long").repartition(len(rows))
    return parts.mapInArrow(trimmed(read), schema)


def default_folder(spark: SparkSession) -> str:
    """A fresh folder for token files in the shared folder, removed when the driver exits."""
    folder = f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    remove_at_exit(spark, folder)
    return folder
