"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Every 23-bit word lies within three errors of exactly one word of the perfect binary Golay code, so
decoding maps it to one of 4096 codeword indices. Words one error apart may decode to different
indices, but the indices of all words within one error of x (one to six of them) always hold the index
of each of those neighbours. A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Of up to
four differing bits, if one segment is free of them, another has two at most: such pairs meet in (index,
exact segment) keys of 33 bits, because words two errors apart have a common neighbour. Otherwise two
segments have one each, the third one or two, and a third of the third none: such pairs meet in (index,
index, exact third) keys of 31 bits. Meeting fingerprints are verified by their exact distance.
"""

from __future__ import annotations

import math
import string
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, text_key, words_of
from .components import connected_components

#: Generator polynomial of the binary [23, 12, 7] Golay code (fixed value): x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0xC75
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Of keep_one: words of a shingle and the least Jaccard similarity, words of the shingles of its fingerprints, and how many.
WORDS, SIMILAR, DRAFT, DRAFTS = 5, 0.8, 2, 4
#: Of _prefixes(): one text in COUNTED is counted for common shingles, those in LEAST of them are common, the KNOWN most common are kept.
COUNTED, LEAST, KNOWN = 16, 4, 1 << 15
#: Shifts and factors of the splitmix64 generator's mixer, and its step (fixed values).
MIXER, GAMMA = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)), 0x9E3779B97F4A7C15
#: Keys with more fingerprints than this are linked through midpoints instead of pairwise.
HOT_KEY = 64


@lru_cache(1)
def golay_table() -> np.ndarray:
    """Codeword index of each 23-bit word."""
    data = np.arange(4096, dtype=np.int64)
    code = data << 11
    for bit in range(22, 10, -1):
        code = np.where(code >> bit & 1, code ^ (GOLAY << (bit - 11)), code)
    code |= data << 11
    table = np.zeros(1 << 23, dtype=np.int16)
    for n in range(4):
        for flips in combinations(range(23), n):
            table[code ^ sum(1 << f for f in flips)] = data
    return table


def _hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each of the text's shingles, repeats included; none where there are no words."""
    from xxhash import xxh64_digest

    words = (text or b"").lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        digests = [xxh64_digest(joined, SEED)] if words else []
    else:
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[: len(words) - shingle + 1].tolist()
        ends = np.concatenate((gaps, [len(joined)]))[shingle - 1:].tolist()
        digests = [xxh64_digest(joined[s:e], SEED) for s, e in zip(starts, ends)]
    return np.frombuffer(b"".join(digests), ">u8").astype(np.uint64)


def _remixed(hashes: np.ndarray, nth: int) -> np.ndarray:
    """The hashes themselves for 0, otherwise a permutation of 64-bit numbers applied to them, another for each nth."""
    if not nth:
        return hashes
    h = hashes ^ np.uint64(nth * GAMMA % (1 << 64))
    for shift, factor in MIXER:
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero without any."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at:at + 255 * 256].astype(">u8").view(np.uint8)).reshape(-1, 64)
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the words' shingles; zero where there are no words."""
    return _majority(_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, many: int = 1) -> DataFrame:
    """(doc_id, key, fp0, fp1, ...) per row of docs: so many fingerprints, each as a signed long.

    The first is fingerprint(); the others take the same shingles under other hashes.
    """
    names = [f"fp{j}" for j in range(many)]

    def run(batches):
        for b in batches:
            hashes = (_hashes(t, shingle) for t in b.column("text").to_pylist())
            fps = np.array([[_majority(_remixed(h, j)) for j in range(many)] for h in hashes], np.uint64).reshape(-1, many)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("key"), *[pa.array(x.view(np.int64)) for x in np.ascontiguousarray(fps.T)]],
                ["doc_id", "key", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", "key long", *[f"{n} long" for n in names]]))


def _near(table: np.ndarray, seg: np.ndarray, bits: int) -> np.ndarray:
    """Codeword indices of each word and of its neighbours, sorted, repeats as -1."""
    flips = np.concatenate(([0], 1 << np.arange(bits)))
    found = np.sort(table[seg[:, None] ^ flips], axis=1).astype(np.int64)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs such that any two fingerprints within four bits share a key."""
    table, u = golay_table(), fps.view(np.uint64)
    segs = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    own = [table[s].astype(np.int64) for s in segs]
    near = [_near(table, s, n) for s, (_, n) in zip(segs, SEGMENTS)]
    rows, keys = [], []

    def emit(kind: int, indices: np.ndarray, rest: np.ndarray, shift: int = 0) -> None:
        """Keys of kind, rest above 12 bits, and each index moved up by shift."""
        r, c = np.nonzero(indices >= 0)
        rows.append(r)
        keys.append(kind << 48 | rest[r] << 12 | indices[r, c] << shift)

    for p, (a, b, c) in enumerate(((0, 1, 2), (0, 2, 1), (1, 2, 0))):
        emit(2 * p, near[a], segs[b])
        emit(2 * p + 1, near[b], segs[a])
        for t in range(3):
            at, n = 7 * t, SEGMENTS[c][1] - 14 if t == 2 else 7
            third = segs[c] >> at & ((1 << n) - 1)
            emit(6 + 3 * p + t, near[a], third << 12 | own[b])
            emit(6 + 3 * p + t, near[b], third << 12, 12)
            keys[-1] |= own[a][rows[-1]]
    row, key = np.concatenate(rows), np.concatenate(keys)
    pairs = np.unique(np.stack((row, key), axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _key_rows(batches):
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 1000):
            part = fps[at:at + 1000]
            row, key = fuzzy_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], ["key", "fp"])


def _bucket_edges(batches):
    """Edges from each fingerprint of a bucket to the smallest of those that it reaches in the bucket."""
    for b in batches:
        lists = b.column("fps")
        sizes = np.diff(lists.offsets.to_numpy())
        values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()[:-1]
        for s in np.unique(sizes).tolist():
            at = starts[sizes == s]
            for k in range(0, len(at), max(1, 400_000 // (s * s))):
                part = np.sort(values[at[k:k + max(1, 400_000 // (s * s)), None] + np.arange(s)], axis=1)
                link = np.bitwise_count((part[:, :, None] ^ part[:, None, :]).view(np.uint64)) <= DISTANCE
                lab = np.broadcast_to(np.arange(s), part.shape)
                while True:
                    new = np.where(link, lab[:, None, :], s).min(axis=2)
                    if (new == lab).all():
                        break
                    lab = new
                r, c = np.nonzero(lab != np.arange(s))
                if len(r):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[r, c]), pa.array(part[r, lab[r, c]])], ["a", "b"])


def _midpoints(batches):
    """Every word within two bits of a fingerprint: two fingerprints within four bits share one."""
    masks = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i, j in combinations(range(64), 2)]
    masks = np.array(masks, dtype=np.uint64)
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 200):
            part = fps[at:at + 200]
            yield pa.RecordBatch.from_arrays(
                [pa.array((part[:, None] ^ masks).ravel().view(np.int64)),
                 pa.array(np.repeat(part, len(masks)).view(np.int64))], ["mid", "fp"])


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints within four bits.

    fps: distinct fingerprints (fp). A key shared by at most HOT_KEY fingerprints is resolved within its
    bucket, which gives no more edges than members. Fingerprints of larger buckets are linked exactly
    through their common midpoints, in rows proportional to their number: no pairs of a group are made.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fingerprint makes some 120 keys
    keys = fps.repartition(tasks, "fp").mapInArrow(_key_rows, "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Merge joins: keys shrink so much in a shuffle that its size is no ground for a broadcast.
    members = materialize(keys.join(shared.hint("merge"), "key"), "members")
    buckets = members.where(F.col("n") <= HOT_KEY).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")
    edges = buckets.mapInArrow(_bucket_edges, "a long, b long")
    hot = materialize(members.where(F.col("n") > HOT_KEY).select("fp").distinct(), "hot")
    if hot.limit(1).count():
        mids = hot.repartition(tasks, "fp").mapInArrow(_midpoints, "mid long, fp long")
        least = mids.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        edges = edges.unionByName(mids.join(least.hint("merge"), "mid").where("fp <> b").select(
            F.col("fp").alias("a"), "b").distinct())
    return edges


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint, component_id) per row of docs (doc_id, text).

    Fingerprints link at four or fewer differing bits; component_id is the smallest doc_id of the
    component. Texts without words, null ones included, have fingerprint zero and link like any other.
    Equal texts share a fingerprint, so copies cost one row in all later steps. Rows that repeat a
    doc_id are kept as they are; a null doc_id is never a component_id unless nothing else is there.
    An empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs).withColumnRenamed("fp0", "fp"), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    nodes = connected_components(fingerprint_links(fps.select("fp")))
    named = fps.join(nodes, fps["fp"] == nodes["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named")
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.join(roots.hint("merge"), "component").select("fp", "component_id")
    return rows.join(by_fp.hint("merge"), "fp").select(
        "doc_id", F.col("key").alias("text_key"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: Column, words: int = WORDS) -> Column:
    """Distinct hashes of the runs of so many words of a text, lower-cased; of a shorter text, of all its words."""
    def runs(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))),
                           lambda i: F.xxhash64(F.array_join(F.slice(w, i, words), " ")))

    # The words are an element, not an expression, inside the lambda, which would split the text for each run.
    w = words_of(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.array_distinct(F.transform(F.array(w), runs)[0])


def _drafted(rows: DataFrame, linked) -> DataFrame:
    """(a, b): each text of rows (key, fp) with the least of its fingerprint, and that with those its fingerprint links to."""
    least = materialize(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    ends = [least.select(F.col("fp").alias(c), F.col("least").alias(f"k{c}")) for c in "ab"]
    links = linked(least.select("fp")).join(ends[0].hint("merge"), "a").join(ends[1].hint("merge"), "b")
    return materialize(links.select(F.col("ka").alias("a"), F.col("kb").alias("b")).unionByName(
        rows.join(least.hint("merge"), "fp").where("key <> least").select(F.col("key").alias("a"), F.col("least").alias("b"))), "drafted")


def _set(text: bytes | None) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted; a single zero where there are no words, so that such texts are alike."""
    found = np.unique(_hashes(text, WORDS))
    return found if len(found) else np.zeros(1, np.uint64)


def _all_tokens(batches):
    for b in batches:
        for t in b.column("text").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(_set(t).view(np.int64))], ["token"])


def _common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and in how many of the counted texts each is."""
    some = texts.where(F.pmod("key", F.lit(COUNTED)) == 0).dropDuplicates(["key"]).mapInArrow(_all_tokens, "token long")
    found = some.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).orderBy(F.desc("n"), "token").limit(KNOWN).toArrow()
    tokens, count = (found.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens.view(np.uint64))
    return tokens.view(np.uint64)[order], count[order]


def _prefixes(texts: DataFrame, similar: float) -> DataFrame:
    """(token, key, n, at): the first shingles of each text (key, text), of n, in an order that is the same for all texts.

    Two sets of that similarity share so many elements that the first which they share is among these of both (prefix
    filtering, Chaudhuri et al., 2006). Any order will do; common shingles come last, so that few texts meet without need.
    Which those are is counted on some texts, which bears on the time only.
    """
    common, count = _common(texts)

    def run(batches):
        seen = set()  # a task gives each text once, however many copies it has
        for b in batches:
            out, held = [], 0
            for key, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    found = _set(text)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
                        found = found[np.lexsort((found, np.where(common[at] == found, count[at], 0)))]
                    first = found[:len(found) - math.ceil(similar * len(found) - 1e-9) + 1]
                    out.append((first.view(np.int64), key, len(found)))
                    held += len(first)
                if held > 100_000:
                    yield _token_rows(out)
                    out, held = [], 0
            if out:
                yield _token_rows(out)

    return texts.mapInArrow(run, "token long, key long, n int, at int")


def _token_rows(out: list) -> pa.RecordBatch:
    sizes = [len(first) for first, _, _ in out]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([first for first, _, _ in out])), pa.array(np.repeat(np.array([k for _, k, _ in out], np.int64), sizes)),
        pa.array(np.repeat(np.array([n for _, _, n in out], np.int32), sizes)),
        pa.array(np.concatenate([np.arange(s, dtype=np.int32) for s in sizes]))], ["token", "key", "n", "at"])


def _fits(similar: float) -> Column:
    """Whether sets of n and m elements, the first that they share at places at and bt, can reach the similarity."""
    most = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    return most >= similar * (F.col("n") + F.col("m") - most) - 1e-6


def _held(docs: DataFrame, links: DataFrame, similar: float) -> DataFrame:
    """The links (a, b) between texts of docs that the exact similarity confirms."""
    asked = materialize(links.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "asked")
    texts = docs.select(text_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(
        asked, "key").dropDuplicates(["key"])
    sets = materialize(texts.select("key", shingles(F.col("text")).alias("set")), "shingles")
    both = links.join(sets.withColumnsRenamed({"key": "a", "set": "x"}).hint("merge"), "a").join(
        sets.withColumnsRenamed({"key": "b", "set": "y"}).hint("merge"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return materialize(both.where(common >= similar * (F.size("x") + F.size("y") - common)).select("a", "b"), "held")


def _first_links(fps: DataFrame) -> DataFrame:
    """Of fingerprint_links() one link (a, b) at most for each fingerprint, to the least of a bucket that it is close to.

    In rows proportional to the fingerprints, however many are close to each other; for drafts, as it finds no more than that.
    """
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = fps.repartition(tasks, "fp").mapInArrow(_key_rows, "key long, fp long")
    stars = keys.withColumn("least", F.min("fp").over(W.partitionBy("key"))).where(
        (F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= DISTANCE))
    return stars.groupBy(F.col("fp").alias("a")).agg(F.min("least").alias("b"))


def _drafts(docs: DataFrame, links=fingerprint_links) -> DataFrame:
    """Links (a, b) between texts that fingerprints of short shingles draft, which an edited word changes least.

    Several under other hashes, one after the other, as each misses pairs that another finds: each text is drafted
    with the least text of its fingerprint, and that one with those of the fingerprints that it links to.
    """
    rows = materialize(fingerprints(docs, DRAFT, DRAFTS).drop("doc_id").distinct(), "fingerprints")
    return reduce(DataFrame.unionByName, [_drafted(rows.select("key", F.col(f"fp{j}").alias("fp")), links) for j in range(DRAFTS)])


def _ordered(links: DataFrame) -> DataFrame:
    return links.select(*[f("a", "b").alias(c) for f, c in ((F.least, "a"), (F.greatest, "b"))]).distinct()


def drafted_texts(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(key, component) as similar_texts() has it, but from the drafted links alone: some links may be missing."""
    links = materialize(_ordered(_drafts(docs)), "links")
    return connected_components(_held(docs, links, similar)).withColumnRenamed("node", "key")


def similar_texts(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(key, component): texts of docs by their hash, linked if the Jaccard similarity of their shingles reaches similar.

    No link between components is left out. Fingerprints draft links; besides, texts that share one of their first
    shingles meet, each first with one of them, in rows proportional to their number. What the exact similarity confirms
    makes components. Texts of different components that still share a first shingle are then compared one by one,
    so that a group of near copies, a component by then, makes no pairs. Texts without links are left out.
    """
    drafts = _drafts(docs, _first_links)
    texts = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    token = W.partitionBy("token")
    shared = materialize(_prefixes(texts, similar).withColumns(
        {"lo": F.min("key").over(token), "hi": F.max("key").over(token)}).where("lo < hi").drop("lo", "hi").distinct(), "tokens")
    pivots = shared.groupBy("token").agg(F.min_by(F.struct("key", "n", "at"), F.xxhash64("token", "key")).alias("p")).select(
        "token", F.col("p.key").alias("b"), F.col("p.n").alias("m"), F.col("p.at").alias("bt"))
    stars = shared.join(pivots.hint("merge"), "token").where("key <> b").where(_fits(similar)).select(F.col("key").alias("a"), "b")
    links = materialize(_ordered(drafts.unionByName(stars)), "links")
    held = _held(docs, links, similar)
    of = connected_components(held)
    named = shared.join(of.hint("merge"), F.col("key") == F.col("node"), "left").select(
        "token", "key", "n", "at", F.coalesce("component", "key").alias("c"))
    apart = materialize(named.withColumns({"lo": F.min("c").over(token), "hi": F.max("c").over(token)}).where("lo < hi").drop("lo", "hi"), "apart")
    other = apart.select("token", F.col("key").alias("b"), F.col("n").alias("m"), F.col("at").alias("bt"), F.col("c").alias("d"))
    pairs = apart.join(other.hint("merge"), "token").where("c < d").where(_fits(similar)).select(F.col("key").alias("a"), "b")
    left = materialize(_ordered(pairs).join(links.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    if not left.isEmpty():
        of = connected_components(held.unionByName(_held(docs, left, similar)))
    return of.withColumnRenamed("node", "key")


def keep_one(docs: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of docs, one per group of near-duplicates: the smallest doc_id, then the smallest text hash.

    Equal texts are one group, and so are texts that similar_texts() links: five-word shingles, similarity 0.8. Unless
    whole, links that no fingerprint drafts may be missing (drafted_texts()).
    Null texts count as empty. Rows that repeat both doc_id and text count as copies, of which one stays. An
    empty table gives an empty result.
    """
    of = (similar_texts if whole else drafted_texts)(docs).select(F.col("key").alias("k"), "component")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    first = rows.join(of.hint("merge"), F.col("key") == F.col("k"), "left").groupBy(F.coalesce("component", "key")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("f")).select(
        F.col("f.doc_id").alias("_d"), F.col("f.key").alias("_k"))
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col("_d"))
                     & (text_key(F.col("text")) == F.col("_k")), "left_semi")
    return kept.dropDuplicates(["doc_id", "text"])
