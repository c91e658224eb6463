"""MinHash near-dedup by a multi-index Hamming join.

A document's set is that of its distinct shingles. Equal sets form a class, which goes on as its document of least id.
A set's signature is ``SIGNATURE`` MinHash values of ``BITS`` bits. The first ``CHUNKS * WIDTH`` values are cut into chunks; a
chunk may hold one error, so each chunk is indexed once for every value that may differ (``WIDTH`` keys of the
others). By the pigeonhole principle all pairs with fewer than ``2 * CHUNKS`` differing values share a key; at a similarity of
0.8 a pair shares none with a probability of about 3e-6.

Links are found and confirmed on full sets in two rounds, so that a key shared by many never becomes all its pairs:

1. In each key, every class is compared with the key's first one. The true links give first components.
2. Keys that still hold several components are looked at pair by pair inside a task, by signatures only; what comes out is
   not pairs but (class, other component) where some signature distance allows a link, once for each. Each such class is
   compared on full sets with all members of that component, in blocks of members. Further links join components for good.

Every link between classes that share a key is thus either confirmed or inside one component already. Components
are found by repeatedly joining neighbours to their least neighbour.

Defined cases: null, empty and wordless texts have an empty set and are linked with nothing; texts of fewer words than a shingle have one shingle,
all their words; rows that repeat an id are rows of their own, each linked by its own text (``first_of_each`` keeps one row of a group, whatever their ids); a null id stands before all others; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm.common import (NULL_ID, as_bytes, as_ids, batch_hashes, blocks, first_of_run, mapped, mix, out, owner_of, partitions, table, texts, windows)
from touchline.session import written

SHINGLE = 5
PERCENT = 80
CHUNKS, WIDTH = 12, 6
SIGNATURE = 128
BITS = 16
FAR = 46  # of SIGNATURE values: at 80 percent, more differ with a probability of about 1e-5
MEMBERS = 256  # of a component in one block
QUERIES = 1024  # against a block in one group
LOOKED = 2048  # members of a key in one block of the second round's look

_R = np.random.default_rng(20240401)
_XOR = _R.integers(0, 2**32, SIGNATURE, dtype=np.uint64).astype(np.uint32)
_ODD = (_R.integers(0, 2**32, SIGNATURE, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def shingle_hashes(data: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, one text after the other, and where each begins."""
    h, starts = batch_hashes([x.translate(_LOWER) for x in data])
    own = owner_of(starts)
    count = np.diff(starts)
    w = mix(windows(h, size)) if len(h) >= size else np.zeros(0, np.uint64)
    at = np.flatnonzero(own[: len(w)] == own[size - 1 :]) if len(w) else np.zeros(0, np.int64)
    key, text = w[at], own[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = [mix(np.array([np.uint64(len(x := h[starts[k] : starts[k + 1]])) * np.uint64(31) + windows(x, len(x))[0]]))[0] for k in short]
        key, text = np.concatenate([key, np.array(whole, np.uint64)]), np.concatenate([text, short])
    order = np.lexsort((key, text))
    key, text = key[order], text[order]
    keep = first_of_run(text, key)
    key, text = key[keep], text[keep]
    begin = np.zeros(len(data) + 1, np.int64)
    np.cumsum(np.bincount(text, minlength=len(data)), out=begin[1:])
    return key, begin


def signatures(key: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A row of SIGNATURE values for each text that has shingles."""
    rows = np.flatnonzero(np.diff(begin))
    found = np.zeros((len(begin) - 1, SIGNATURE), np.uint16)
    if len(rows):
        x, at = (key >> np.uint64(32)).astype(np.uint32), begin[rows]
        for k in range(SIGNATURE):
            least = np.minimum.reduceat((x ^ _XOR[k]) * _ODD[k], at)
            found[rows, k] = ((least * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint16)
    return found


_SKETCH = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("signature", pa.binary())])
SKETCH = "doc_id long, n_shingles long, f1 long, f2 long, signature binary"


def _sketched(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            key, begin = shingle_hashes(as_bytes(batch), size)
            n = np.diff(begin)
            total = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([mix(key + np.uint64(1)), mix(key ^ np.uint64(0x5555555555555555))], axis=1, dtype=np.uint64)], axis=1)
            f1, f2 = (total[k, begin[1:]] - total[k, begin[:-1]] for k in range(2))
            yield out(_SKETCH, as_ids(batch), n, f1.view(np.int64), f2.view(np.int64), [s.tobytes() for s in signatures(key, begin)])

    return run


_KEYS = pa.schema([("key", pa.int64()), ("doc", pa.int64())])


def chunk_keys(s: np.ndarray) -> np.ndarray:
    """CHUNKS * WIDTH keys of each signature: every chunk without one of its values in turn."""
    found = np.empty((len(s), CHUNKS * WIDTH), np.uint64)
    for c in range(CHUNKS):
        values = s[:, c * WIDTH : (c + 1) * WIDTH].astype(np.uint64)
        for left_out in range(WIDTH):
            k = np.full(len(s), c * WIDTH + left_out + 1, np.uint64)
            for v in range(WIDTH):
                if v != left_out:
                    k = mix(k * np.uint64(0x9E3779B97F4A7C15) + values[:, v] + np.uint64(1))
            found[:, c * WIDTH + left_out] = k
    return found


def _as_signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SIGNATURE)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for s in range(0, whole.num_rows, 2000):
            batch = whole.slice(s, 2000)
            keys = chunk_keys(_as_signatures(batch.column(1)))
            yield out(_KEYS, keys.ravel().view(np.int64), np.repeat(np.asarray(batch.column(0)), keys.shape[1]))


# --- exact comparison --------------------------------------------------------


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _overlaps(size: int, percent: int, first_only: bool):
    """Streams rows (grp, part, asks, doc, text), sorted by group with members before the asking ones; links of those that ask with members."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, sets, index = None, [], [], None
        for batch in blocks(batches):
            group = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            asks, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            key, begin = shingle_hashes(as_bytes(batch), size)
            a, b = [], []
            for k, g in enumerate(group):
                if g != now:
                    now, docs, sets, index = g, [], [], None
                mine = key[begin[k] : begin[k + 1]]
                if not asks[k]:
                    docs.append(ids[k])
                    sets.append(mine)
                    continue
                if index is None:
                    count = np.array([len(x) for x in sets], np.int64)
                    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    owner = np.repeat(np.arange(len(sets)), count)
                    order = np.argsort(every, kind="stable")
                    index = every[order], owner[order], count, np.array(docs, np.int64)
                every, owner, count, names = index
                if not len(names) or not len(mine):
                    continue
                lo, hi = np.searchsorted(every, mine, "left"), np.searchsorted(every, mine, "right")
                hit = lo < hi
                common = np.bincount(owner[_spread(lo[hit], hi[hit])], minlength=len(count))
                linked = (100 * common >= percent * (len(mine) + count - common)) & (names != ids[k])
                to = names[linked][:1] if first_only else names[linked]
                a += [ids[k]] * len(to)
                b += to.tolist()
            if a:
                yield out(_LINK, a, b)

    return run


def _spread(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    n = hi - lo
    return np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def confirmed(asked: DataFrame, members: DataFrame, known: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between ``asked`` (grp, doc) and the ``members`` (grp, doc) of the same group. Members are cut into blocks,
    the asking ones of a group too, and every block of one meets every block of the other."""
    def sliced(df: DataFrame, most: int, name: str) -> DataFrame:
        n = df.groupBy("grp").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
        return df, n

    (asked, na), (members, nm) = sliced(asked, QUERIES, "_na"), sliced(members, MEMBERS, "_nm")
    sizes = written(na.join(nm, "grp"), "near-blocks")

    def placed(df: DataFrame, own: str, other: str, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("doc"), F.col(own)).cast("int")
        df = df.join(sizes, "grp").withColumn("_mine", mine).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("_mine", "_other") if asks else ("_other", "_mine")
        return df.select("grp", (F.col(i) * F.col("_nm") + F.col(j)).alias("part"), F.lit(asks).alias("asks"), "doc")

    rows = placed(asked, "_na", "_nm", True).unionByName(placed(members, "_nm", "_na", False))
    rows = rows.join(known, "doc").select("grp", "part", "asks", "doc", "text")
    rows = rows.repartition(partitions(rows), "grp", "part").sortWithinPartitions("grp", "part", "asks", "doc")
    return mapped(rows, _overlaps(size, percent, False), "a long, b long")


# --- components ---------------------------------------------------------------


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(doc, component) of every document in ``links`` (a, b): the least id that can be reached. Large and small stars in
    turn, each a sum by key and a join; the links shrink to stars in a number of rounds logarithmic in a chain's length."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "near-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # larger neighbours go to the least one
        large = written(large.where("u > v").distinct(), "near-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = written(small.where("u > v").distinct(), "near-edges")
        same = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 2**40).alias("h")).first() == new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 2**40).alias("h")).first()
        edges = new
        if same:
            break
    tops = edges.select(F.col("v").alias("doc")).distinct().select("doc", F.col("doc").alias("component"))
    return edges.select(F.col("u").alias("doc"), F.col("v").alias("component")).unionByName(tops)


# --- the second round's look at a key -------------------------------------------


_WANT = pa.schema([("doc", pa.int64()), ("grp", pa.int64())])


def _open_pairs(far: int, percent: int):
    """Streams rows (key, part, block, doc, component, weight, n, signature) sorted by key and part: (doc, other component) where a
    link is possible, if this is the first key that the pair shares. The smaller component asks. Pairs stay inside the task."""
    def look(key, block, doc, comp, weight, n, sig):
        shared, found = chunk_keys(sig), set()
        cross = block.min() != block.max()  # of two blocks, only pairs between them: their own have parts of their own
        for i in range(len(doc) - 1):
            j = np.arange(i + 1, len(doc))
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])) & ((block[j] != block[i]) if cross else True)]
            if not len(j):
                continue
            j = j[(sig[j] != sig[i]).sum(1) <= far]
            if not len(j):
                continue
            j = j[shared[i, (shared[j] == shared[i]).argmax(1)].view(np.int64) == key]
            for k in j.tolist():
                x, y = (i, k) if (weight[i], comp[i]) <= (weight[k], comp[k]) else (k, i)
                found.add((int(doc[x]), int(comp[y])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def done(tab: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, part, block, doc, comp, weight, n = (np.asarray(tab.column(k)) for k in range(7))
            sig = _as_signatures(tab.column(7).combine_chunks())
            cuts = np.flatnonzero(first_of_run(keys, part))
            every: set = set()
            for s, e in zip(cuts, np.append(cuts[1:], len(keys))):
                every |= look(keys[s], block[s:e], doc[s:e], comp[s:e], weight[s:e], n[s:e], sig[s:e])
            if every:
                a, b = zip(*sorted(every))
                yield out(_WANT, list(a), list(b))

        for batch in batches:
            if not batch.num_rows:
                continue
            tab = pa.Table.from_batches([batch])
            if rest is not None:
                tab = pa.concat_tables([rest, tab])
            cut = int(np.flatnonzero(first_of_run(np.asarray(tab.column(0)), np.asarray(tab.column(1))))[-1])  # the last group may go on
            if cut:
                yield from done(tab.slice(0, cut))
            rest = tab.slice(cut)
        if rest is not None and rest.num_rows:
            yield from done(rest)

    return run


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): components of documents linked by a similarity of ``percent`` or more.

    Where an id has several texts, null ids included, rows are numbered and linked as rows; a component's id is then the least id of its rows."""
    df = texts(docs, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    sketch = written(mapped(df, _sketched(size), SKETCH), "near-sketch")
    text_of = F.struct("f1", "f2", "n_shingles")
    if sketch.groupBy("doc_id").agg(F.min(text_of).alias("lo"), F.max(text_of).alias("hi")).where("lo < hi").isEmpty():
        found = _components_of(df, sketch, size, percent)
    else:
        rows = written(df.withColumn("row", F.monotonically_increasing_id()), "near-numbered")
        own = rows.select(F.col("row").alias("doc_id"), "text")
        marks = written(_components_of(own, written(mapped(own, _sketched(size), SKETCH), "near-sketch"), size, percent), "near-rows-marked")
        named = marks.withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row").withColumnRenamed("component_id", "own")
        least = named.groupBy("own").agg(F.min("doc_id").alias("component_id"))
        found = named.join(least, "own")
    plain = [F.when(F.col(c) != NULL_ID, F.col(c)).alias(c) for c in ("doc_id", "component_id")]
    return found.select(plain[0], "n_shingles", plain[1], (F.col("doc_id") == F.col("component_id")).alias("kept"))


def _components_of(df: DataFrame, sketch: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc_id, n_shingles, component_id) for (doc_id, text), where an id has one text."""
    spark = df.sparkSession
    full = sketch.where("n_shingles > 0")
    classes = written(full.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature")), "near-classes")
    keys = mapped(classes.select("doc", "signature"), _keyed, "key long, doc long")
    leads = keys.groupBy("key").agg(F.min("doc").alias("lead"), F.max("doc").alias("last")).where("lead < last").select("key", "lead")
    shared = written(keys.join(leads, "key").select("key", "lead", "doc"), "near-keys")
    involved = shared.select("doc").distinct()
    known = written(df.join(involved, df["doc_id"] == involved["doc"], "left_semi").select(F.col("doc_id").alias("doc"), "text").dropDuplicates(["doc"]), "near-texts")

    asked = shared.where("doc <> lead").select(F.col("lead").alias("grp"), "doc").distinct()
    links = written(confirmed(asked, asked.select("grp").distinct().withColumn("doc", F.col("grp")), known, size, percent), "near-links")
    first = written(components(spark, links), "near-components")

    placed = shared.select("key", "doc").join(first, "doc", "left").select("key", "doc", F.coalesce("component", "doc").alias("component"))
    placed = written(placed, "near-placed")
    open_keys = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    weight = first.groupBy("component").agg(F.count("*").alias("weight"))
    looked = (placed.join(open_keys, "key").join(weight, "component", "left").withColumn("weight", F.coalesce("weight", F.lit(1)))
              .join(classes.select("doc", F.col("n_shingles").alias("n"), "signature"), "doc").select("key", "doc", "component", "weight", "n", "signature"))
    # A key's members are cut into blocks; every two blocks, and every block alone, are one part.
    size_of = placed.join(open_keys, "key").groupBy("key").agg(F.ceil(F.count("*") / LOOKED).cast("int").alias("blocks"))
    looked = looked.join(written(size_of, "near-sizes"), "key").withColumn("block", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    looked = looked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.least("block", "other") * F.col("blocks") + F.greatest("block", "other")
    looked = looked.select("key", part.alias("part"), "block", "doc", "component", "weight", "n", "signature")
    looked = looked.repartition(partitions(looked), "key", "part").sortWithinPartitions("key", "part", "doc")
    wanted = written(mapped(looked, _open_pairs(FAR, percent), "doc long, grp long").distinct(), "near-wanted")
    groups = wanted.select("grp").distinct()
    members = involved.join(first, "doc", "left").select("doc", F.coalesce("component", "doc").alias("grp")).join(groups, "grp")
    more = written(confirmed(wanted, members.select("grp", "doc"), known, size, percent), "near-more")
    final = written(components(spark, links.unionByName(more)), "near-final")

    of_class = classes.join(final, "doc", "left").select("f1", "f2", "n_shingles", F.coalesce("component", "doc").alias("component"))
    rows = sketch.join(of_class, ["f1", "f2", "n_shingles"], "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return rows.select("doc_id", "n_shingles", "component_id")


def first_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group of near copies, that of least id, null before all others; the columns of docs, unchanged.
    Rows are told apart by a number of their own, so those without an id or with one id are rows as any other."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()), "near-rows")
    id_, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    marks = near_duplicates(rows.select("row", F.col(text).alias("text")), size, percent, id_col="row")
    marks = written(marks.select(F.col("doc_id").alias("row"), "component_id", "kept"), "near-marks")
    groups = marks.where("NOT kept").select("component_id").distinct()
    members = written(marks.join(groups, "component_id").join(rows.select("row", F.col(id_).cast("long").alias("id")), "row"), "near-members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNotNull().alias("named"), "id", "row"))["row"].alias("first"))
    gone = members.join(first, "component_id").where("row <> first").select("row")
    return rows.join(written(gone, "near-gone"), "row", "left_anti").drop("row").toDF(*docs.columns)


def op4_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 2)
