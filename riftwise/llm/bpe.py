"""Byte-level BPE over a distinct-word table.

Texts are split in chunks: runs of documents of one task whose distinct words are numbered. A document
becomes the numbers of its words by position, a chunk lists each distinct word once, so that no word is hot
however often it occurs. The chunks' words meet in buckets by hash, as many as their number asks for, where each
distinct one is encoded once; its ids go back to the chunks that hold it. Ids decode through a join with
the table of pieces: the ids that a chunk holds are joined to it, and go to the chunk. The same plan runs at
every size; nothing is sent to all tasks but the pieces, which the vocabulary bounds.

Texts are split twice, for their words and for their numbers, as numbers written out and shuffled would take
more disk than the texts. A digest of a chunk's words tells if both times made the same chunk: they do when rows
are read from files; any other source must be written out first, or the query fails.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, remove, shared_path, text_key, written

#: Distinct words, and words in all, at which a chunk ends, after the document that reaches them.
CHUNK, LONG = 300_000, 8_000_000
#: Words of all chunks that a bucket gets, about, and that a row of a chunk holds at most.
BUCKET, ROW = 300_000, 50_000
#: Python's and the tokenizer's Unicode tables agree below this; other texts are split by the tokenizer itself.
AGREED = 0x530


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pattern() -> str:
    """The splitting pattern of byte-level BPE, its letters, numbers and spaces written out below AGREED."""
    kinds = {k: "".join(f"\\u{c:04x}" for c in range(AGREED) if unicodedata.category(chr(c))[0] == k) for k in "LN"}
    letter, number, space = kinds["L"], kinds["N"], "\\t-\\r \\x85\\xa0"
    return (f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+"
            f"|[{space}]+(?![^{space}])|[{space}]+")


class Splitter:
    """Splits texts into words and special tokens, as the tokenizer does before its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.find = re.compile(pattern()).findall
        self.newer = re.compile(f"[{chr(AGREED)}-{chr(0x10FFFF)}]").search
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    def _words(self, text: str) -> list[str]:
        if text.isascii() or not self.newer(text):
            return self.find(text)
        return [text[s:e] for _, (s, e) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self._words(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.special else self._words(part)
        return out

    def encode(self, words: list[str]) -> list[list[int]]:
        encode = self.tokenizer.encode  # one by one: a batch of short words costs more
        return [encode(w, add_special_tokens=False).ids for w in words]

    def pieces(self) -> list[bytes]:
        """Bytes of each id. Printable bytes stand for themselves, the others for characters from U+0100 on."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {chr(b): b for b in plain} | {
            chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = token not in self.special and all(c in char for c in token)
            out[i] = bytes(char[c] for c in token) if known else token.encode()
        return out


@lru_cache(2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       F.coalesce("text", F.lit("")).alias("text"))


def _pack(numbers) -> bytes:
    """32-bit numbers with their first, second, third and fourth bytes together, compressed."""
    x = np.asarray(numbers, np.uint32)
    return zlib.compress(x.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _chunks(docs: DataFrame, path: str, bound: int, words_only: bool) -> DataFrame:
    """(chunk, mark, first, words): a chunk's distinct words, commonest first, from number first; or its documents.

    Documents are rows (chunk, mark, doc_id, key, seq): seq packs the numbers of the document's words by position.
    mark is a digest of the chunk's words.
    """
    def split(batches):
        s, task, n, number, ids, seqs, total = splitter(path), 0, 0, {}, [], [], 0

        def rows():
            count = np.bincount(np.concatenate([*seqs, np.zeros(0, np.uint32)]), minlength=len(number))
            order = np.argsort(-count, kind="stable")
            words = list(number)
            words = [words[i] for i in order.tolist()]
            mark = int.from_bytes(hashlib.blake2b("\0".join(words).encode(), digest_size=7).digest(), "little")
            same = lambda size: [pa.array(np.full(size, task << 24 | n)), pa.array(np.full(size, mark))]
            if words_only:
                for at in range(0, len(words), ROW):
                    yield pa.RecordBatch.from_arrays(
                        [*same(1), pa.array([at], pa.int32()), pa.array([words[at:at + ROW]], pa.list_(pa.string()))], names)
                return
            to = np.empty(len(order), np.uint32)
            to[order] = np.arange(len(order))
            for at in range(0, len(seqs), 500):
                doc, key = zip(*ids[at:at + 500])
                yield pa.RecordBatch.from_arrays(
                    [*same(len(doc)), pa.array(doc, pa.int64()), pa.array(key, pa.int64()),
                     pa.array([_pack(to[x]) for x in seqs[at:at + 500]], pa.binary())], names)

        for b in batches:
            for task, doc, key, text in zip(*[b.column(c).to_pylist() for c in ("task", "doc_id", "key", "text")]):
                words = s.words(text)
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                ids.append((doc, key))
                seqs.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                total += len(words)
                if len(number) > bound or total > LONG:
                    yield from rows()
                    n, number, ids, seqs, total = n + 1, {}, [], [], 0
        if ids:
            yield from rows()

    schema = "chunk long, mark long, " + ("first int, words array<string>" if words_only else "doc_id long, key long, seq binary")
    names = [c.split()[0] for c in schema.split(", ")]
    # The number of the partition within this table: a task of a union counts otherwise.
    return _texts(docs).withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(split, schema)


def _encoded_words(words: DataFrame, path: str) -> DataFrame:
    """(chunk, mark, ats, sizes, ids, used): ids of a chunk's words, a row a bucket, from (chunk, mark, first, words).

    ats packs the steps from each word's number to the next, sizes how many ids each has, used lists the distinct ids.
    """
    buckets = (words.agg(F.sum(F.size("words"))).first()[0] or 0) // BUCKET + 1

    def deal(batches):
        for b in batches:
            for chunk, mark, first, some in zip(*[b.column(c).to_pylist() for c in ("chunk", "mark", "first", "words")]):
                some = [w.encode() for w in some]
                to = np.fromiter((zlib.crc32(w) for w in some), np.int64, len(some)) % buckets
                order = np.argsort(to, kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(to[order])) + 1) if len(order) else ():
                    mine = [some[i] for i in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([to[at[0]]]), pa.array([chunk]), pa.array([mark]), pa.array([_pack(np.diff(at + first, prepend=0))], pa.binary()),
                         pa.array([_pack([len(w) for w in mine])], pa.binary()),
                         pa.array([zlib.compress(b"".join(mine), 1)], pa.binary())], ["bucket", "chunk", "mark", "ats", "sizes", "text"])

    def encode(batches):
        s, now, known = splitter(path), None, {}
        for b in batches:
            for bucket, chunk, mark, ats, sizes, text in zip(*[b.column(c).to_pylist() for c in (
                    "bucket", "chunk", "mark", "ats", "sizes", "text")]):
                if bucket != now:
                    now, known = bucket, {}
                text, end, got = zlib.decompress(text), 0, []
                for n in _unpack(sizes).tolist():
                    w = text[end:end + n]
                    end += n
                    ids = known.get(w)
                    if ids is None:  # each word is encoded once
                        ids = known[w] = s.encode([w.decode()])[0]
                    got.append(ids)
                flat = np.array([i for x in got for i in x], np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk]), pa.array([mark]), pa.array([ats], pa.binary()), pa.array([_pack([len(x) for x in got])], pa.binary()),
                     pa.array([_pack(flat)], pa.binary()), pa.array([np.unique(flat).astype(np.int32)], pa.list_(pa.int32()))],
                    ["chunk", "mark", "ats", "sizes", "ids", "used"])

    dealt = words.mapInArrow(deal, "bucket long, chunk long, mark long, ats binary, sizes binary, text binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        encode, "chunk long, mark long, ats binary, sizes binary, ids binary, used array<int>")


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, piece): the bytes of each id; its size is the vocabulary's."""
    rows = splitter(path or default_path()).pieces()
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(rows)), pa.int32()),
                                           "piece": pa.array(rows, pa.binary())}))


def _pieces_of(used: DataFrame, path: str) -> DataFrame:
    """(chunk, id, piece): the ids that each chunk holds, from (chunk, used), joined to the table of pieces."""
    lists = used.groupBy("chunk").agg(F.array_distinct(F.flatten(F.collect_list("used"))).alias("used"))  # the words bound it
    ids = lists.select("chunk", F.explode("used").alias("id"))
    # The vocabulary bounds the table of pieces.
    return ids.join(F.broadcast(piece_table(used.sparkSession, path)), "id").select("chunk", "id", "piece")


def _per_document(docs: DataFrame, path: str, finish, schema: str, decode: bool, bound: int) -> DataFrame:
    """(doc_id, text_key, schema's columns) per row of docs: the words' ids joined back by position.

    finish(ids, pieces) gets the ids of a chunk's words and the bytes of each id, and gives a function from
    a list of word numbers arrays to columns. A task holds one chunk's words at a time.
    """
    spark = docs.sparkSession
    at = shared_path(spark, "words")
    words = _encoded_words(written(_chunks(docs, path, bound, True), at), path)
    if decode:
        words = materialize(words, "encoded")
        remove(spark, at)  # the encoded words hold all that is read from here on
    none = lambda **kinds: [F.lit(None).cast(t).alias(c) for c, t in kinds.items()]
    parts = words.select("chunk", "mark", F.lit(1).alias("kind"), "ats", "sizes", "ids", *none(id="int", doc_id="long", key="long")).unionByName(
        _chunks(docs, path, bound, False).select("chunk", "mark", F.lit(2).alias("kind"), F.col("seq").alias("ats"),
                                                 *none(sizes="binary", ids="binary", id="int"), "doc_id", "key"))
    if decode:
        parts = parts.unionByName(_pieces_of(words.select("chunk", "used"), path).select(
            "chunk", *none(mark="long"), F.lit(0).alias("kind"), F.col("piece").alias("ats"), *none(sizes="binary", ids="binary"), "id",
            *none(doc_id="long", key="long")))
    names = ["doc_id", "text_key", *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        now, ids, pieces, ready, known = None, [], {}, None, 0
        for b in batches:
            out = []
            for chunk, mark, kind, ats, sizes, flat, i, doc, key in zip(*[b.column(c).to_pylist() for c in (
                    "chunk", "mark", "kind", "ats", "sizes", "ids", "id", "doc_id", "key")]):
                if chunk != now:
                    if out:
                        yield batch(out, ready)
                        out = []
                    now, ids, pieces, ready, known = chunk, [], {}, None, None
                if kind == 0:
                    pieces[i] = ats
                elif kind == 1:
                    ids.append((ats, sizes, flat))
                    known = mark
                else:
                    if known is not None and known != mark:
                        raise ValueError("documents came in another order the second time: write them out first")
                    if ready is None:
                        ready, ids = finish(_by_number(ids), pieces), []
                    out.append((doc, key, _unpack(ats)))
            if out:
                yield batch(out, ready)

    def batch(out, ready):
        doc, key, seqs = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), *ready(seqs)], names)

    dealt = parts.repartition("chunk").sortWithinPartitions("chunk", "kind")
    return dealt.mapInArrow(run, f"doc_id long, text_key long, {schema}")


def _by_number(parts) -> list[list[int]]:
    """Ids of a chunk's words by their numbers."""
    parts = [[np.cumsum(_unpack(ats)), _unpack(sizes), _unpack(flat)] for ats, sizes, flat in parts]
    out: list[list[int]] = [[]] * sum(len(ats) for ats, _, _ in parts)
    for ats, sizes, flat in parts:
        flat, end = flat.tolist(), 0
        for at, n in zip(ats.tolist(), sizes.tolist()):
            out[at] = flat[end:end + n]
            end += n
    return out


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, text_key, ids) per row of docs (doc_id, text); null and empty texts have no ids.

    As the tokenizer encodes whole texts without adding special tokens; the special token's own string
    in a text becomes its id. Rows that repeat a doc_id are encoded one by one. An empty table gives an
    empty result.
    """
    def finish(ids, pieces):
        return lambda seqs: [pa.array([[i for w in s.tolist() for i in ids[w]] for s in seqs], pa.list_(pa.int32()))]

    return _per_document(docs, path or default_path(), finish, "ids array<int>", False, chunk)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """encoded (ids, ...) with the column decoded added: the bytes of the ids' pieces, read as UTF-8.

    The distinct ids of each partition of rows are joined to the pieces. Bytes that are no UTF-8 become
    U+FFFD. Null ids give null; an unknown id is an error. A column named decoded is replaced.
    """
    path = path or default_path()
    rows = encoded.drop("decoded")
    names, schema = rows.columns, encoded.drop("decoded").schema.add("decoded", "string")
    held = materialize(rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                                   F.spark_partition_id().cast("long").alias("chunk")), "ids")
    used = held.where("row.ids is not null").select("chunk", F.array_distinct("row.ids").alias("used"))
    empty = F.lit(None).cast(held.schema["row"].dataType)
    parts = held.select("chunk", F.lit(1).alias("kind"), "row", F.lit(None).cast("int").alias("id"), F.lit(None).cast("binary").alias("piece"))
    parts = parts.unionByName(_pieces_of(used, path).select("chunk", F.lit(0).alias("kind"), empty.alias("row"), "id", "piece"))

    def run(batches):
        now, pieces = None, {}
        for b in batches:
            chunk, kind = b.column("chunk").to_pylist(), b.column("kind").to_pylist()
            row, take, out = b.column("row"), [], []
            ids = row.field("ids").to_pylist()
            for at, (c, k) in enumerate(zip(chunk, kind)):
                if c != now:
                    now, pieces = c, {}
                if k == 0:
                    pieces[b.column("id")[at].as_py()] = b.column("piece")[at].as_py()
                else:
                    take.append(at)
                    out.append(None if ids[at] is None else b"".join([pieces[i] for i in ids[at]]).decode("utf-8", "replace"))
            if take:
                got = row.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*got.flatten(), pa.array(out, pa.string())], [*names, "decoded"])

    return parts.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of docs: texts encoded, then decoded from ids.

    Null texts are empty. Rows that repeat a doc_id are encoded one by one. An empty table gives an empty result.
    """
    def finish(ids, pieces):
        sizes = np.array([len(x) for x in ids], np.int64)
        names = {i: str(i) for i in pieces}
        # After each id a comma, of which a text's last one goes; decoded bytes come from the ids alone.
        listed = ["".join([names[i] + "," for i in x]) for x in ids].__getitem__
        decoded = [b"".join([pieces[i] for i in x]) for x in ids].__getitem__

        def rows(seqs):
            n, one, two = [], [], []
            for s in seqs:
                n.append(int(sizes[s].sum()))
                s = s.tolist()
                one.append(hashlib.sha256("".join(map(listed, s))[:-1].encode()).hexdigest())
                two.append(hashlib.sha256(b"".join(map(decoded, s)).decode("utf-8", "replace").encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]

        return rows

    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _per_document(docs, path or default_path(), finish, schema, True, chunk).drop("text_key")
