"""MinHash near-duplicate detection with tensored banding.

1. Each document's set of distinct five-word shingles (64-bit hashes) is made in Arrow batches. Documents with equal sets (two 64-bit sums
   over the set and its size) form one class; only its smallest doc_id goes on, so copies cost nothing further.
2. Two collections, A and B, have SUBKEYS sub-keys each, every one of ROWS minhashes. A table (i, j) is keyed by A_i and B_j together. So
   144 tables of eight rows need 96 minhashes instead of 1152. Sets of Jaccard similarity s meet in some table with probability
   (1 - (1 - s**4)**12)**2: 0.9997 at 0.85, 0.996 at 0.8 and more above, but 0.29 at 0.5.
   A table key can only be shared if both its sub-keys are. So sub-keys are counted first, and only shared ones of a document are
   combined: nearly all documents without relatives end there, and the shuffle carries 24 sub-keys a document, not 144 table keys.
3. Verification by hubs. Documents that share a table key form a bucket, whose hub is the one that meets most others over all its keys. Each is compared with the hub, exactly, on full
   sets made from the texts again; those that are linked leave the bucket, the others get a hub of their own, for HUBS rounds. A hub's
   members are cut into chunks of TILE by a hash, and each chunk gets the hub's text, so a round moves each text as often as it has hubs (mostly once)
   and no task holds more than a chunk: a family of near copies costs in proportion to its size. Texts of documents in no bucket are not moved. Texts are
   moved rather than sets, as five-word shingles take 8 bytes a word and text less than 7.
4. What hubs can not decide. Distance (one minus similarity) is a metric, so a document further than twice the least distance from a hub has no
   link with any that is linked to the hub: such a pair needs no look. Documents between once and twice, and those still in a bucket after HUBS rounds,
   may have links that no hub saw. The verified components that they touch are joined into families, and every pair of a family that lies in
   different components is verified, not only those that met. Families are cut into tiles; a component above half a TILE has tiles of its
   own, and pairs of tiles of one component are left out. Each other pair of tiles is a unit of work, so no task holds more than 2 * TILE sets.
   Intersections are counted by a matrix product over the shingles that occur twice. Of the links found, a unit returns a spanning
   forest, so what it emits is linear in its documents. Nothing is capped.
5. Components of all links, with copies joined back by their class, give component_id.

Known cost: only documents whose links hubs could not decide are compared in pairs of tiles, which grows with the square of their number in one family.

Defined results: fewer than five words are one shingle; a null, empty or wordless text has an empty set and is linked with
nothing; rows with equal doc_id give a row each and count as one document whose sets are linked; a row with a null doc_id is linked with
nothing, its component_id is null and it is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textkit
from tessera.llm.components import connected_components
from tessera.llm.shared import discard, materialise, shuffle_partitions, tune

SHINGLE = 5
#: Least similarity, as a fraction: of op5, and of the pipeline's stage.
LEAST = (85, 100)
STAGE_LEAST = (80, 100)
SUBKEYS = 12
ROWS = 4
TILE = 512
HUBS = 3

_ROW = "_near_duplicates_row"
_HASHES = 2 * SUBKEYS * ROWS
_MULTIPLY = np.random.default_rng(20240229).integers(1, 1 << 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, first shingle of each text): repeated ones repeat."""
    w = textkit.words_of(data, offsets, textkit.space_words())
    h, counts = w.hashes(), w.counts
    number = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    at = textkit.gather_ranges(w.first[:-1], number)
    length = np.repeat(np.minimum(counts, size), number)
    out = length.astype(np.uint64)
    for k in range(size):
        has = length > k
        if has.all():
            out = textkit.mix(out * _FOLD + h[at + k])
        else:
            out[has] = textkit.mix(out[has] * _FOLD + h[at[has] + k])
    return out, np.concatenate([[0], np.cumsum(number)])


def distinct_sets(shingles: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each text's distinct shingles, ascending, first of each text)."""
    texts = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.argsort(shingles)
    order = order[np.argsort(texts[order].astype(np.uint16 if len(first) < 1 << 16 else np.int64), kind="stable")]
    shingles, texts = shingles[order], texts[order]
    new = np.ones(len(shingles), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (texts[1:] != texts[:-1])
    return shingles[new], np.concatenate([[0], np.cumsum(np.bincount(texts[new], minlength=len(first) - 1))])


def _per_text(ufunc: np.ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """ufunc over each text's values; texts without values are left out."""
    return ufunc.reduceat(values, first[:-1][np.diff(first) > 0])


def sub_keys(sets: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts with values, 2 * SUBKEYS) keys: ROWS minhashes each; the first half is collection A, the rest B."""
    out = []
    for k in range(2 * SUBKEYS):
        key = None
        for r in range(ROWS):
            lowest = _per_text(np.minimum, sets * _MULTIPLY[k * ROWS + r] >> np.uint64(16), first)
            key = lowest if key is None else textkit.mix(key * _FOLD + lowest)
        out.append(textkit.mix(key + np.uint64(k)))
    return np.stack(out, axis=1) if out else np.zeros((0, 2 * SUBKEYS), np.uint64)


def sketches(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set and its sub-keys (null for an empty set)."""
    tune(docs.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in textkit.slices(batch.column("text"), textkit.SLICE_BYTES // 2):
                sets, first = distinct_sets(*shingle_hashes(data, offsets, size))
                counts = np.diff(first)
                full = counts > 0
                one, two = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                keys = np.zeros((hi - lo, 2 * SUBKEYS), np.uint64)
                if full.any():
                    one[full] = _per_text(np.add, textkit.mix(sets + np.uint64(1)), first)
                    two[full] = _per_text(np.add, textkit.mix(sets ^ _FOLD), first)
                    keys[full] = sub_keys(sets, first)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * 2 * SUBKEYS, 2 * SUBKEYS, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column("doc_id").slice(lo, hi - lo).cast(pa.int64()), "n_shingles": pa.array(counts), "set_one": pa.array(one.view(np.int64)), "set_two": pa.array(two.view(np.int64)), "sub_keys": flat}
                )

    return docs.select("doc_id", "text").mapInArrow(sketch, "doc_id long, n_shingles long, set_one long, set_two long, sub_keys array<long>")


def buckets(classes: DataFrame) -> DataFrame:
    """(key, id, hub): documents that share a table key, with the key's hub. classes: (id, sub_keys)."""
    each = classes.select("id", F.posexplode("sub_keys").alias("place", "value"))
    shared = each.groupBy("place", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    own = each.join(shared, ["place", "value"]).groupBy("id").agg(F.collect_list(F.struct("place", "value")).alias("keys"))  # 2 * SUBKEYS at most
    side = lambda low: F.filter("keys", lambda k: (k["place"] < SUBKEYS) == F.lit(low))
    tables = own.select("id", F.explode(side(True)).alias("x"), side(False).alias("others")).select("id", "x", F.explode("others").alias("y"))
    keyed = tables.select("id", F.xxhash64("x.place", "x.value", "y.place", "y.value").alias("key"))
    return materialise(_with_hubs(materialise(keyed, "table-keys")), "buckets")


def _with_hubs(keyed: DataFrame) -> DataFrame:
    """(key, id, hub) of the keys that hold several ids. The hub is the one that meets most others over all its keys (ties to the smaller id): the original of
    edited copies, which is nearer to each of them than they are to each other."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = keyed.join(several, "key")
    meets = sized.groupBy("id").agg(F.sum("n").alias("meets"))
    hubs = sized.join(meets, "id").groupBy("key").agg(F.max(F.struct("meets", (-F.col("id")).alias("id"))).alias("best"))
    return keyed.join(hubs.select("key", (-F.col("best.id")).alias("hub")), "key").select("key", "id", "hub")


# Verification ------------------------------------------------------------------------------------------------------------


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, least: tuple[int, int] = LEAST) -> np.ndarray:
    """A boolean matrix: whether set left[i] and set right[j] reach the least similarity."""
    sizes = np.array([len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = counts > 1
    column = np.where(common, np.cumsum(common) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(sets)), sizes)
    row, column = row[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    inter = np.zeros((len(left), len(right)), np.float64)
    where_left, where_right = np.full(len(sets), -1), np.full(len(sets), -1)
    where_left[left], where_right[right] = np.arange(len(left)), np.arange(len(right))
    for at in range(0, int(common.sum()), 2048):
        a, b = np.searchsorted(column, [at, at + 2048])
        r, c = row[a:b], column[a:b] - at
        x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
        keep = where_left[r] >= 0
        x[where_left[r[keep]], c[keep]] = 1
        keep = where_right[r] >= 0
        y[where_right[r[keep]], c[keep]] = 1
        inter += x @ y.T
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    return least[1] * inter >= least[0] * union


def forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Star edges (smallest id of a component, other id) of the graph that links left[i] with right[j]."""
    label = np.arange(len(ids))
    label = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # rank by id, so the least label is the least id
    rank_to_id = np.sort(ids)
    i, j = np.nonzero(links)
    a, b = left[i], right[j]
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        if (new == label).all():
            break
        label = new
    return [(int(rank_to_id[x]), int(i)) for x, i in zip(label.tolist(), ids.tolist(), strict=True) if rank_to_id[x] != i]


def measured_links(links: DataFrame, texts: DataFrame, size: int, least: tuple[int, int], tile: int) -> DataFrame:
    """(a, b, linked, near) for links (hub a, member b): whether their similarity reaches the least, and whether it is within twice its distance."""
    spark = links.sparkSession
    chunks = links.groupBy("a").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("chunks"))
    members = links.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), F.col("b").alias("id"), F.lit(1).alias("role"))
    hubs = chunks.select("a", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("id"), F.lit(0).alias("role"))
    # a merge join at every size: links grow with the documents, so a plan that broadcasts them would only hold for small inputs
    work = texts.join(members.unionByName(hubs).hint("merge"), "id").select("a", "chunk", "role", "id", "text")
    work = work.repartition(shuffle_partitions(spark), "a", "chunk").sortWithinPartitions("a", "chunk", "role")
    (num, den), kind = least, "a long, b long, linked boolean, near boolean"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own = None, []  # the hub's sets: rows with an equal id may have several
        for batch in batches:
            out = []
            rows = list(zip(*[batch.column(k).to_pylist() for k in ("a", "chunk", "role", "id")], strict=True))
            for lo, hi, data, offsets in textkit.slices(batch.column("text"), textkit.SLICE_BYTES // 2):
                sets, first = distinct_sets(*shingle_hashes(data, offsets, size))
                for k in range(lo, hi):
                    a, chunk, role, doc = rows[k]
                    if unit != (a, chunk):
                        unit, own = (a, chunk), []
                    mine = sets[first[k - lo] : first[k - lo + 1]]
                    if role == 0:
                        own.append(mine.copy())
                        continue
                    linked = near = False
                    for hub in own:
                        if len(hub) and len(mine) and den * min(len(hub), len(mine)) >= (2 * num - den) * max(len(hub), len(mine)):
                            at = np.minimum(np.searchsorted(hub, mine), len(hub) - 1)
                            both = int((hub[at] == mine).sum())
                            union = len(hub) + len(mine) - both
                            linked |= den * both >= num * union
                            near |= den * both >= (2 * num - den) * union
                    out.append((a, doc, linked, near))
            if out:
                a, b, linked, near = zip(*out, strict=True)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "linked": pa.array(linked, pa.bool_()), "near": pa.array(near, pa.bool_())})

    return work.mapInArrow(measure, kind).groupBy("a", "b").agg(F.max("linked").alias("linked"), F.max("near").alias("near"))


def hub_links(found: DataFrame, texts: DataFrame, size: int, least: tuple[int, int], tile: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(links, doubts) from buckets (key, id, hub): exact links with hubs, and pairs whose families are still to be compared."""
    links, doubts = [], []
    for _ in range(rounds):
        asked = found.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
        measured = materialise(measured_links(asked, texts, size, least, tile), "measured")
        links.append(measured.where("linked").select("a", "b"))
        doubts.append(measured.where("near and not linked").select("a", "b"))
        failed = measured.where("not linked").select(F.col("a").alias("hub"), F.col("b").alias("id"))
        left = materialise(found.join(failed, ["hub", "id"], "left_semi").select("key", "id"), "failed")
        found = materialise(_with_hubs(left), "buckets")
        if found.isEmpty():
            break
    else:
        doubts.append(found.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")))
    every = lambda parts: functools.reduce(DataFrame.unionByName, parts)
    return every(links), every(doubts).distinct()


def families(components: DataFrame, doubts: DataFrame) -> DataFrame | None:
    """(id, component, family) of the components that doubts join, or None where there are none. components: (id, component)."""
    named = lambda side: components.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
    across = doubts.join(named("a"), "a", "left").join(named("b"), "b", "left")
    across = materialise(across.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b").distinct(), "doubts")
    if across.isEmpty():
        return None
    joined = materialise(connected_components(across).select(F.col("id").alias("component"), F.col("component").alias("family")), "families")
    inside = components.join(joined, "component").select("id", "component", "family")
    alone = joined.join(components.select("component").distinct(), "component", "left_anti").select(F.col("component").alias("id"), "component", "family")
    return materialise(inside.unionByName(alone), "family-members")


def tiled(members: DataFrame, tile: int) -> DataFrame:
    """members (id, component, family) with own, their tile's number in the family, and the units (i, j) of tiles that they are compared in."""
    sizes = members.groupBy("family", "component").agg(F.count("*").alias("n"))
    large = F.col("n") > tile // 2
    small = sizes.where(~large).groupBy("family").agg(F.ceil(F.sum("n") / F.lit(tile)).cast("int").alias("mixed"))
    order = Window.partitionBy("family").orderBy("component")  # a row for every half tile of documents
    own = sizes.where(large).withColumn("tiles", F.ceil(F.col("n") / F.lit(tile)).cast("int")).join(small, "family", "left").fillna(0, ["mixed"])
    own = own.withColumn("from", (F.col("mixed") + F.sum("tiles").over(order) - F.col("tiles")).cast("int")).select("family", "component", "from", "tiles")
    all_tiles = own.groupBy("family").agg(F.sum("tiles").alias("own_tiles"))
    counts = members.select("family").distinct().join(small, "family", "left").join(all_tiles, "family", "left").fillna(0)
    placed = members.join(own, ["family", "component"], "left").join(counts, "family")
    alone = F.col("from").isNotNull()
    number = F.when(alone, F.col("from") + F.pmod(F.xxhash64("id"), F.col("tiles"))).otherwise(F.pmod(F.xxhash64("component"), F.col("mixed"))).cast("int")
    others = F.sequence(F.lit(0), (F.col("mixed") + F.col("own_tiles") - 1).cast("int"))
    needed = F.filter(others, lambda k: ~F.coalesce((k >= F.col("from")) & (k < F.col("from") + F.col("tiles")), F.lit(False)))  # not with its own component's
    placed = placed.withColumn("own", number).withColumn("needed", needed)
    return placed.select("id", "family", "own", F.explode(F.transform("needed", lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))).alias("unit"))


def family_links(members: DataFrame, texts: DataFrame, size: int, least: tuple[int, int], tile: int) -> DataFrame:
    """(a, b): a spanning forest of the exact links between components of a family. members: (id, component, family); texts: (id, text)."""
    units = tiled(members, tile)
    work = texts.join(units.hint("merge"), "id").select(F.col("family").alias("component"), "unit.i", "unit.j", "own", "id", "text")
    n = shuffle_partitions(members.sparkSession)
    work = work.repartition(n, "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        unit = None

        def close() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            ids = np.array([h[0] for h in held])
            own = np.array([h[1] for h in held])
            sets = [h[2] for h in held]
            _, i, j = unit
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            if not len(left) or not len(right):
                return []
            return forest(similar(sets, left, right, least), left, right, ids)

        for batch in batches:
            found = []
            columns = [batch.column(k).to_pylist() for k in ("component", "i", "j", "own", "id")]
            rows = list(zip(*columns, strict=True))
            for lo, hi, data, offsets in textkit.slices(batch.column("text"), textkit.SLICE_BYTES // 2):
                sets, first = distinct_sets(*shingle_hashes(data, offsets, size))
                for k in range(lo, hi):
                    component, i, j, own, doc = rows[k]
                    if unit != (component, i, j):
                        found += close()
                        held.clear()
                        unit = (component, i, j)
                    held.append((doc, own, sets[first[k - lo] : first[k - lo + 1]].copy()))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})
        found = close()
        if found:
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return work.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = LEAST, tile: int = TILE, hubs: int = HUBS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = materialise(sketches(docs, size), "sketches")
    key = ["n_shingles", "set_one", "set_two"]
    linked = drawn.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(linked.groupBy(*key).agg(F.min("doc_id").alias("id"), F.any_value("sub_keys").alias("sub_keys")), "classes")
    found = buckets(classes)
    texts = materialise(docs.select(F.col("doc_id").alias("id"), "text").join(found.select("id").distinct().hint("merge"), "id", "left_semi"), "candidate-texts")
    links, doubts = hub_links(found, texts, size, least, tile, hubs)
    # rows with equal doc_id but different sets
    again = linked.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    own = linked.join(again, "doc_id").join(classes.drop("sub_keys"), key).select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    components = materialise(connected_components(links.unionByName(own)), "components")
    members = families(components, doubts)
    if members is not None:
        more = materialise(family_links(members, texts, size, least, tile), "links")
        components = materialise(connected_components(components.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more)), "components")
    named = classes.drop("sub_keys").join(components, "id", "left").select(*key, F.coalesce("component", "id").alias("component"))
    placed = linked.drop("sub_keys").join(named, key).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = drawn.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, size: int = SHINGLE, least: tuple[int, int] = STAGE_LEAST) -> DataFrame:
    """docs with one row of each group of near duplicates: the one with the smallest doc_id. Where ids repeat, rows are told apart by their texts and
    not by their ids: rows of one id whose texts are not linked all stay, and of a group's rows with the smallest id the first read stays. Rows without
    an id or without words always stay."""
    if docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        found = materialise(near_duplicates(docs, size, least), "near-duplicates")
        gone = found.where("not kept").select("doc_id").distinct()
        return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)  # at every size, as above
    numbered = materialise(docs.withColumn(_ROW, F.monotonically_increasing_id()), "numbered")
    named = numbered.where("doc_id is not null").select(F.col(_ROW).alias("doc_id"), "text")
    found = materialise(near_duplicates(named, size, least), "near-duplicates").select(F.col("doc_id").alias(_ROW), "component_id")
    best = numbered.select(_ROW, "doc_id").join(found, _ROW).groupBy("component_id").agg(F.min(F.struct("doc_id", _ROW))[_ROW].alias(_ROW))
    gone = found.select(_ROW).join(best.select(_ROW), _ROW, "left_anti")
    return numbered.join(gone.hint("merge"), _ROW, "left_anti").select(*docs.columns)


def reference_components(rows: list[tuple], size: int = SHINGLE, least: tuple[int, int] = LEAST) -> dict[int, tuple[int, int]]:
    """Brute force for tests, for distinct ids: doc_id -> (n_shingles, component_id)."""
    import re

    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if least[1] * min(len(x), len(y)) >= least[0] * max(len(x), len(y)):
                both = len(x & y)
                if least[1] * both >= least[0] * (len(x) + len(y) - both):
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}
