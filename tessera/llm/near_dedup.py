"""MinHash near-duplicate detection with odd sketches.

Documents are sets of distinct 5-word shingles; two are linked when their Jaccard
similarity is at least a threshold in per cent.  240 MinHash samples give as many rows a
band as let two sets at the threshold miss each other once in 10**8 pairs at most: 40
bands of 6 rows at 85, 48 of 5 at 80.

Candidates are checked on odd sketches: the shingles of smallest hash (bottom MinHash
samples, all below a threshold that leaves 512 to 1,024 of them, or the whole set if it
is smaller) flip one parity each in a bitmap of 1,024 bits.  The population count of the
XOR of two sketches is at most the number of samples in which the sets differ, and near
it as long as the sets are similar - so it tells similarities of 0.8 from 0.85, where
240 equal-or-not samples would not.  A pair is ruled out when its count exceeds what a
link allows: exactly for whole sets, at odds of 10**-9 for samples.  All other candidate
pairs are confirmed on the full sets.

Hashes only find candidates.  Links are confirmed on the words themselves, and texts
that differ are one class only after their shingles, written out, have the same SHA-256.

No bucket is turned into all its pairs.  Equal sets are one class.  In each bucket a
pivot (the member that shares most buckets, which is the original rather than an
edit of it) is compared with all others; components then show which buckets are
settled, and a settled bucket is done, since all its links lie within a component.
After a few rounds what is left - pairs across components that share a bucket with
no pivot between - is compared sketch by sketch in blocks of bounded size.  Thus no
link across components is lost, hot buckets cost one row per member and round, and
no task holds a whole bucket.

Defined results: null and empty texts and texts without a word have an empty set, no
class and no link; a text of less than five words is one shingle; texts of any length
are read whole; repeated rows are one class (``deduplicate`` leaves them to exact
dedup); an id with several texts belongs to the class of each, row by row; rows with
a null id belong to no class, have a null component and stay; an empty table gives an
empty result; other columns are ignored, and ``deduplicate`` returns them untouched
whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmaps import anti_by_key, named, semi_by_id
from tessera.llm.caching import owned
from tessera.llm.components import connected_components
from tessera.llm.store import Workspace, rows_of
from tessera.llm.textscan import Words, blocks, mix64, shingle_sets

SHINGLE = 5
#: Links have percent * union <= 100 * intersection.  ``near_groups`` has op1's threshold
#: unless told otherwise, ``deduplicate`` that of near duplicates in a corpus.
GROUPS_PERCENT, DEDUP_PERCENT = 85, 80
SAMPLES = 240
#: Odds at which two sets at the threshold may share no band.
MISSES = 1e-8
SKETCH_BITS = 1024
SKETCH_WORDS = SKETCH_BITS // 64
#: Samples a sketch holds at most, in expectation.
SKETCH_SAMPLES = 1024
PIVOT_ROUNDS = 2
#: Pairs of texts that a task confirms.
CONFIRM_ROWS = 4000
#: Rows of a block when the rest of a bucket is compared in blocks.
BLOCK_ROWS = 256

_U = np.uint64
_FACTORS = (mix64(np.arange(1, SAMPLES + 1, dtype=_U)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = (mix64(np.arange(1001, SAMPLES + 1001, dtype=_U)) >> _U(32)).astype(np.uint32)


def samples(shingles: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of shingle hashes."""
    x = (shingles >> _U(32)).astype(np.uint32)
    best = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        hashed = np.multiply.outer(_FACTORS, x[at : at + 1024])
        hashed += _OFFSETS[:, None]
        np.minimum(best, hashed.min(axis=1), out=best)
    return best


def sketch_level(size) -> np.ndarray:
    """Halvings that leave at most SKETCH_SAMPLES of so many shingles."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(size, 1) / SKETCH_SAMPLES))).astype(np.int64)


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """Parity bitmaps, as 64-bit words, of the samples of the set's level and of the next.

    Sets that can be linked differ by one level at most, so two of them always have
    a level in common.
    """
    level = int(sketch_level(len(shingles)))
    out = np.zeros((2, SKETCH_WORDS), _U)
    for k in range(2):
        kept = shingles[: np.searchsorted(shingles, _U(1) << _U(64 - level - k))] if level + k else shingles
        parity = np.bincount((kept % _U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
        out[k] = np.packbits(parity.astype(np.uint8)).view(_U)
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows a band: the most rows that keep to MISSES at the threshold.

    Below 50 per cent, linked sets could be two sketch levels apart.
    """
    if not 50 <= percent <= 100:
        raise ValueError(f"a threshold of {percent} per cent is not within 50 to 100")
    rows = max(r for r in range(1, 13) if (1 - (percent / 100) ** r) ** (SAMPLES // r) <= MISSES)
    return SAMPLES // rows, rows


def may_link(size_a, sketch_a, size_b, sketch_b, percent: int = DEDUP_PERCENT) -> np.ndarray:
    """Whether sketches (rows of two levels) of sets of such sizes allow a link.

    percent * union <= 100 * intersection means that the sets differ in at most
    (100 - percent) * (sum of sizes) / (100 + percent) shingles; of samples, at
    most seven standard deviations more than their share of these.
    """
    level_a, level_b = sketch_level(size_a), sketch_level(size_b)
    level = np.maximum(level_a, level_b)
    most = (100 - percent) * (size_a + size_b) // (100 + percent)
    share = most / 2.0**level
    most = np.where(level == 0, most, share + 7 * np.sqrt(share) + 10)
    rows = np.arange(len(sketch_a))
    one, two = sketch_a[rows, np.minimum(level - level_a, 1)], sketch_b[rows, np.minimum(level - level_b, 1)]
    return (np.bitwise_count(one ^ two).sum(axis=1) <= most) & (np.abs(level_a - level_b) <= 1)


def band_keys(sampled: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band."""
    banded = sampled[: bands * rows].reshape(bands, rows).astype(_U)
    keys = np.arange(bands, dtype=_U)
    for k in range(rows):
        keys = mix64(keys * _U(0x9E3779B97F4A7C15) + banded[:, k])
    return keys


def _digest(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, the same for equal sets."""
    n = _U(len(shingles))
    a, b = mix64(shingles + _U(0x1234567)), mix64(shingles ^ _U(0x9876543210ABCDEF))
    return int((a.sum(dtype=_U) + n).view(np.int64)), int((b.sum(dtype=_U) ^ n).view(np.int64))


def signatures(docs: DataFrame, percent: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles, and for sets that are not empty the text's SHA-256, digest (hi, lo), sketch and bands."""
    n_bands, n_rows = banding(percent)

    def run(batches):
        owned("near")
        for batch in batches:
            for first, raw, offs in blocks(batch.column(1)):
                words = Words(raw, offs)
                sets = shingle_sets(words.hashes(fold_case=True), words.first, SHINGLE)
                sha, hi, lo, sketch, bands = [], [], [], [], []
                for i, s in enumerate(sets):
                    if not len(s):
                        for column in (sha, hi, lo, sketch, bands):
                            column.append(None)
                        continue
                    sha.append(hashlib.sha256(raw[offs[i] : offs[i + 1]]).digest())
                    a, b = _digest(s)
                    sampled = samples(s)
                    hi.append(a)
                    lo.append(b)
                    sketch.append(odd_sketch(s).tobytes())
                    bands.append(band_keys(sampled, n_bands, n_rows).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(sha, pa.binary()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "sha", "hi", "lo", "sketch", "bands"],
                )

    return docs.select(named(id_column).cast("long"), named(text_column)).mapInArrow(run, "doc_id long, n_shingles long, sha binary, hi long, lo long, sketch binary, bands array<long>")


def written_out(text: bytes) -> frozenset[tuple[bytes, ...]]:
    """The shingles of a text as tuples of its words, about 150 bytes a word."""
    words = text.lower().split()  # of bytes: A-Z and the same white space only
    if len(words) < SHINGLE:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[k:] for k in range(SHINGLE))))


def _set_digest(shingles: frozenset[tuple[bytes, ...]]) -> bytes:
    """SHA-256 of a set, written in order: no word holds a space or a line's end."""
    return hashlib.sha256(b"\n".join(sorted(map(b" ".join, shingles)))).digest()


def _unpacked(sketches) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, 2, SKETCH_WORDS)


def _pass_sketch(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose odd sketches allow a link."""

    def run(batches):
        owned("near")
        for batch in batches:
            sizes = [batch.column(k).to_numpy() for k in (2, 4)]
            packed = [_unpacked(batch.column(k).to_pylist()) for k in (3, 5)]
            near = may_link(sizes[0], packed[0], sizes[1], packed[1], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(near))

    one = sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "n_a", "sketch_a", "n_b", "sketch_b")
    return both.mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (doc_id, sha, ...) with their texts; repeated rows of docs give one."""
    hits = semi_by_id(docs, wanted, "doc_id").withColumn("sha", F.unhex(F.sha2("text", 256)))
    return wanted.join(hits.dropDuplicates(["doc_id", "sha"]), ["doc_id", "sha"])


def _exact_classes(variants: DataFrame, docs: DataFrame, work: Workspace) -> DataFrame:
    """(hi, lo, sha, exact): of different texts with one digest the SHA-256 of the set."""

    def run(batches):
        owned("near")
        for batch in batches:
            exact = [_set_digest(written_out(t.as_py())) for t in batch.column(3).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(exact, pa.binary())], ["hi", "lo", "sha", "exact"])

    mixed = variants.groupBy("hi", "lo").agg(F.count("*").alias("texts")).filter("texts > 1")
    wanted = work.keep(variants.join(mixed, ["hi", "lo"], "left_semi").select("doc_id", "sha", "hi", "lo"), "mixed-texts", rows_of(variants))
    return work.sized(_texts(docs, wanted).select("hi", "lo", "sha", "text"), rows_of(wanted), CONFIRM_ROWS).mapInArrow(run, "hi long, lo long, sha binary, exact binary")


def _confirm(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, work: Workspace, percent: int) -> DataFrame:
    """The pairs (a, b) that are links on the full sets, word by word.

    Only texts of documents in a pair are shuffled.  A sort-merge join hands the
    rows over sorted by the pivot b, so the set of a pivot is built once per task.
    """

    def run(batches):
        owned("near")
        last, pivot = None, frozenset()
        for batch in batches:
            one, two = (batch.column(k).cast(pa.large_binary()) for k in (2, 3))
            links = []
            for i, b in enumerate(batch.column(1).to_pylist()):
                if b != last:
                    last, pivot = b, written_out(two[i].as_py())
                other = written_out(one[i].as_py())
                common = len(other & pivot)
                links.append(100 * common >= percent * (len(other) + len(pivot) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(links, pa.bool_()))

    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = work.keep(nodes.join(ids, "node", "left_semi").select("node", "doc_id", "sha"), "pair-ids", 2 * rows_of(pairs))
    texts = work.keep(_texts(docs, wanted).select("node", "text"), "pair-texts", rows_of(wanted), CONFIRM_ROWS)
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _block_pairs(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of rows (key, node, weight, label) of one key with different
    labels whose sketches allow a link, compared in pairs of blocks."""

    def compare(group):
        owned("near")
        sketch = _unpacked(group["sketch"])
        ids, labels, block, weight, size = (group[name].to_numpy() for name in ("node", "label", "block", "weight", "n_shingles"))
        one, two = (np.flatnonzero(block == group[side].iloc[0]) for side in ("left", "right"))
        out = []
        for i in one:
            other = two[labels[two] != labels[i]]
            near = other[may_link(np.full(len(other), size[i]), np.broadcast_to(sketch[i], (len(other), *sketch[i].shape)), size[other], sketch[other], percent)]
            out += [(ids[i], ids[j]) if (weight[i], -ids[i]) < (weight[j], -ids[j]) else (ids[j], ids[i]) for j in near]
        return pd.DataFrame({"a": [a for a, _ in out], "b": [b for _, b in out]}, dtype="int64")

    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("n_blocks"))
    placed = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    spread = placed.withColumn("other", other).select("key", "node", "weight", "label", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
    return spread.join(sketches, "node").groupBy("key", "left", "right").applyInPandas(compare, "a long, b long")


def _grouped(docs: DataFrame, work: Workspace, id_column: str, text_column: str, percent: int) -> DataFrame:
    """doc_id, sha, n_shingles, component_id and kept of every row.

    A node is a class of equal sets, named by the first of its rows; documents come in
    again at the end, as the least id of a component's classes.
    """
    docs = docs.select(named(id_column).cast("long").alias("doc_id"), named(text_column).alias("text"))
    signed = work.keep(signatures(docs, percent).withColumn("row", F.monotonically_increasing_id()), "signatures")
    variants = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo", "sha").agg(F.min("doc_id").alias("doc_id"), F.min("row").alias("row"))
    variants = work.keep(variants, "variants", rows_of(signed))
    exact = _exact_classes(variants, docs, work)
    none = F.lit(b"")
    variants = work.keep(variants.join(exact, ["hi", "lo", "sha"], "left").withColumn("exact", F.coalesce("exact", none)), "classed", rows_of(variants))
    first = F.min(F.struct("row", "doc_id", "sha"))
    classes = variants.groupBy("hi", "lo", "exact").agg(first.alias("first"), F.min("doc_id").alias("least"))
    classes = work.keep(classes.select("hi", "lo", "exact", "least", F.col("first.row").alias("node"), F.col("first.doc_id").alias("doc_id"), F.col("first.sha").alias("sha")), "classes", rows_of(variants))
    nodes = classes.select("node", "doc_id", "sha")
    reps = work.keep(signed.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("node"), "n_shingles", "sketch", "bands"), "representatives", rows_of(classes))
    sketches = reps.select("node", "n_shingles", "sketch")

    rows, most = reps.select("node", F.explode("bands").alias("key")), rows_of(reps) * banding(percent)[0]
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1")
    member = work.keep(rows.join(shared, "key"), "members", most)
    weight = member.groupBy("node").agg(F.sum("members").alias("weight"))
    open_rows = work.keep(member.join(weight, "node").select("key", "node", "weight", F.col("node").alias("label")), "open", rows_of(member))

    links: list[DataFrame] = []
    tested: list[DataFrame] = []
    labels = None

    def test(pairs: DataFrame, within: int | None) -> DataFrame:
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = work.keep(pairs, "pairs", within)
        tested.append(pairs)
        near = work.keep(_pass_sketch(pairs, sketches, percent), "near", rows_of(pairs))
        links.append(work.keep(_confirm(near, docs, nodes, work, percent), "links", rows_of(near), CONFIRM_ROWS))
        every = links[0]
        for more in links[1:]:
            every = every.unionByName(more)
        return connected_components(every, work, within=rows_of(*links))

    for turn in range(PIVOT_ROUNDS):
        if not rows_of(open_rows):
            break
        pivots = open_rows.groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("order"), "label")).alias("top"))
        pivots = work.keep(pivots.select("key", (-F.col("top.order")).alias("pivot"), F.col("top.label").alias("pivot_label")), "pivots", rows_of(open_rows) // 2)
        against = work.keep(open_rows.join(pivots, "key").filter("node <> pivot"), "against", rows_of(open_rows))
        labels = test(against.filter("label <> pivot_label").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), rows_of(against))
        relabelled = against.select("key", "node", "weight").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
        relabelled = work.keep(relabelled, "relabelled", rows_of(against))
        unsettled = relabelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        open_rows = work.keep(relabelled.join(unsettled, "key", "left_semi").select("key", "node", "weight", "label"), "open", rows_of(relabelled))
    else:
        if rows_of(open_rows):
            labels = test(_block_pairs(open_rows, sketches, percent).distinct(), None)

    if labels is None:
        grouped = classes.withColumn("component", F.col("node"))
    else:
        grouped = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = work.keep(grouped.select("hi", "lo", "exact", "least", "component"), "grouped", rows_of(classes))
    lowest = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    # sets that one document alone has need no component
    own = grouped.join(lowest, "component").select("hi", "lo", "exact", "component_id")
    out = signed.select("doc_id", "sha", "n_shingles", "hi", "lo").join(variants.filter(F.col("exact") != none).select("hi", "lo", "sha", "exact"), ["hi", "lo", "sha"], "left").withColumn("exact", F.coalesce("exact", none))
    out = out.join(own, ["hi", "lo", "exact"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "sha", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
    return work.sized(out, rows_of(signed))


def near_groups(docs: DataFrame, work: Workspace, id_column: str = "doc_id", text_column: str = "text", percent: int = GROUPS_PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    return _grouped(docs, work, id_column, text_column, percent).drop("sha")


def deduplicate(docs: DataFrame, work: Workspace, id_column: str = "doc_id", text_column: str = "text", percent: int = DEDUP_PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, with all columns.

    A row is known by its id and its text; only rows whose id is among those to drop
    are looked at by text.
    """
    groups = _grouped(docs, work, id_column, text_column, percent)
    probe = F.col("doc_id")
    dropped = work.keep(groups.filter("NOT kept").select(probe.alias("probe"), F.concat(probe.cast("string"), F.lit(":"), F.lower(F.hex("sha"))).alias("key")), "dropped")
    own = named(id_column).cast("long")
    return anti_by_key(docs, own, F.concat(own.cast("string"), F.lit(":"), F.sha2(named(text_column), 256)), dropped)
