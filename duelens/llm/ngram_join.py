"""N-gram Jaccard join.

Documents become sets of hashed word shingles. Sets that can reach the threshold differ in at most
``(x + y) * (1 - t) / (1 + t)`` shingles, so when the range of hashes is cut into more segments
than that, some segments hold the same shingles in both. A tile is a size band, a segment and the
sum of the segment's mixed hashes. Within a tile, the difference of two 2048-bit parity bitmaps
bounds the overlap from above; what passes is intersected exactly as sorted arrays.

Equal sets are one node. Rounds join the components of neighbours: in every crowded tile that still holds several
components, its nodes are put in an order that differs from round to round, and neighbours of different components are
candidate pairs. The closest pairs of each node are verified, and what holds joins components. As neighbours are a random
sample of the pairs in a tile, they tell how many pairs pass the bitmaps. When these are in proportion to the
rows, or few of a round's pairs link, all nodes of a tile are compared, crowded tiles in
blocks and only nodes of different components; pairs that share enough tiles and pass the bitmaps are verified. So no link
between components is lost, and the pairs inside a large group of near copies are not listed.

A null text is an empty text. An empty set is linked with nothing. Null ids name no document:
such rows take part only through equal sets, and a set without any id has a null component.
Rows with equal ids are one document whose texts are all compared. Texts are read whole, whatever their length.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelens.llm.words import (
    Out,
    WordHashes,
    components,
    gram_hashes,
    lower_spaced_words,
    mixed,
    rows_of,
)
from duelens.operators.staging import discard, staged

BITMAP_WORDS = 32
#: Tiles with more nodes are cut into blocks of about as many.
BLOCK = 1000
#: Tiles with more nodes take part in the rounds.
CROWD = 8
#: Neighbours on one side that a node of a tile is compared with in a round.
REACH = 3
#: Bits of the filter for texts that take part in a round (1 MB).
FILTER_BITS = 1 << 23
_SET_TYPES = (
    "doc_id long, source long, text_key long, n_shingles long, set_key binary, bitmap array<long>"
)
_SEEN_SETS = 100_000


def shingle_set(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """The distinct shingles as sorted hashes; fewer words than ``width`` make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(gram_hashes(hashes.of(words), min(width, len(words))))


@lru_cache(maxsize=20_000)
def bands(percent: int, size: int) -> list[tuple[int, int, int, bool]]:
    """(number, segments, spare segments, at home) of the band of a set's size and of the next one.

    A set and a partner of the same size or larger lie in one band or in neighbouring ones.
    Sets so small that only an equal set reaches the threshold have none.
    """
    number, upper = 0, 100 // percent
    while size > upper:
        number, upper = number + 1, (upper + 1) * 100 // percent
    uppers = enumerate((upper, (upper + 1) * 100 // percent), number)
    apart = [(n, 2 * u * (100 - percent) // (100 + percent)) for n, u in uppers]
    spare = [(n, most + 1, (most + 1) // 5 + 2) for n, most in apart if most]
    return [(n, least + more, more, n == number) for n, least, more in spare]


def tiles_of(shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile keys of a set, whether it is at home in their band (its own band and the next), and
    how many tiles of the band a partner shares with it at least.

    With ``spare`` segments more than needed, sets that link share ``spare + 1`` of them. So segments without
    a shingle, which say nothing, are left out if they are no more than that.
    """
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles), dtype=np.uint64)])
    keys, homes, least = [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0, np.int16)]
    for number, segments, spare, home in bands(percent, len(shingles)):
        step = (1 << 64) // segments
        edges = np.arange(1, segments, dtype=np.uint64) * np.uint64(step)
        cuts = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
        held = sums[cuts[1:]] - sums[cuts[:-1]]
        place = np.arange(segments, dtype=np.uint64) + np.uint64(number << 32)
        found = mixed(mixed(place + np.uint64(1)) ^ held)
        full = np.diff(cuts) > 0
        # A partner may leave empty segments out even if this set cannot.
        left_out, needed = segments - np.count_nonzero(full), 1
        if left_out <= spare:
            found, needed = found[full], spare + 1 - left_out
        keys.append(found)
        homes.append(np.full(len(found), home))
        least.append(np.full(len(found), needed, np.int16))
    return np.concatenate(keys), np.concatenate(homes), np.concatenate(least)


def parity_bitmap(shingles: np.ndarray) -> np.ndarray:
    """2048 bits; a bit says whether an odd number of shingles fall on it."""
    bits = 64 * BITMAP_WORDS
    places = (shingles >> np.uint64(7)) % np.uint64(bits)
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _set_rows(width: int):
    schema = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("source", pa.int64()),
            ("text_key", pa.int64()),
            ("n_shingles", pa.int64()),
            ("set_key", pa.binary()),
            ("bitmap", pa.list_(pa.int64())),
        ]
    )

    def run(batches):
        out, hashes = Out(schema), WordHashes()
        for doc_id, source, text_key, text in rows_of(batches):
            shingles = shingle_set(lower_spaced_words(text), width, hashes)
            key = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
            row = doc_id, source, text_key, len(shingles), key, parity_bitmap(shingles)
            if out.add(*row):
                yield out.batch()
        yield out.batch()

    return run


def _tile_rows(width: int, percent: int):
    """(source, text) -> (tile, source, home, needed); of equal sets that meet in a task one is enough."""
    schema = pa.schema(
        [("tile", pa.int64()), ("source", pa.int64()), ("home", pa.bool_()), ("needed", pa.int16())]
    )

    def batch(*columns):
        arrays = [pa.array(np.concatenate(c)) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        hashes, seen = WordHashes(), set()
        tiles, ids, homes, least, held = [], [], [], [], 0
        for source, text in rows_of(batches):
            shingles = shingle_set(lower_spaced_words(text), width, hashes)
            key = hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
            if key in seen:
                continue
            if len(seen) < _SEEN_SETS:
                seen.add(key)
            found, home, needed = tiles_of(shingles, percent)
            tiles.append(found.view(np.int64))
            ids.append(np.full(len(found), source, np.int64))
            homes.append(home)
            least.append(needed)
            held += len(found)
            if held > 50_000:
                yield batch(tiles, ids, homes, least)
                tiles, ids, homes, least, held = [], [], [], [], 0
        if held:
            yield batch(tiles, ids, homes, least)

    return run


def _shared_shingles(left: bytes, right: bytes) -> int:
    """Size of the intersection of two sorted arrays of distinct hashes."""
    x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    at = np.searchsorted(y, x)
    return int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(x) and len(y) else 0


def _filter_bits(sources: DataFrame) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits, whatever the number of ``sources``: all of them pass, most others not."""
    bit = _filter_bit() + 1
    rows = (
        sources.select(
            F.bitmap_bucket_number(bit).alias("part"), F.bitmap_bit_position(bit).alias("place")
        )
        .groupBy("part")
        .agg(F.bitmap_construct_agg("place").alias("bits"))
        .collect()
    )
    held = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in rows:
        some = np.frombuffer(row.bits, np.uint8)
        start = (row.part - 1) * len(some)
        held[start : start + len(some)] = some[: len(held) - start]
    return held


def _filter_bit() -> F.Column:
    return F.pmod(F.xxhash64("source"), F.lit(FILTER_BITS))


def _arrays(width: int, bits: np.ndarray):
    """(bit, text) -> (set_key, shingles) of the rows that pass the filter."""
    schema = pa.schema([("set_key", pa.binary()), ("shingles", pa.binary())])

    def run(batches):
        out, hashes = Out(schema), WordHashes()
        for batch in batches:
            bit = batch.column(0).to_numpy()
            passed = bits[bit >> 3] >> (bit & 7) & 1
            for text in batch.column(1).take(pa.array(np.flatnonzero(passed))):
                shingles = shingle_set(lower_spaced_words(text.as_py()), width, hashes).tobytes()
                key = hashlib.blake2b(shingles, digest_size=16).digest()
                if out.add(key, shingles, size=len(shingles)):
                    yield out.batch()
        yield out.batch()

    return run


def _exact(percent: int):
    schema = pa.schema([(c, pa.int64()) for c in ("a", "b", "left", "right")])

    def run(batches):
        out = Out(schema)
        for a, b, left, right, x, y in rows_of(batches):
            shared, both = _shared_shingles(x, y), (len(x) + len(y)) // 8
            if 100 * shared >= percent * (both - shared) and out.add(a, b, left, right):
                yield out.batch()
        yield out.batch()

    return run


def _of(node: str | F.Column, name: str) -> F.Column:
    """A column of a node: of an aliased table, or of a struct."""
    return F.col(f"{node}.{name}") if isinstance(node, str) else node[name]


def _differing_bits(left: str | F.Column, right: str | F.Column) -> F.Column:
    x, y = _of(left, "bitmap"), _of(right, "bitmap")
    bits = [F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(BITMAP_WORDS)]
    return sum(bits[1:], bits[0])


def _may_link(left: str | F.Column, right: str | F.Column, percent: int) -> F.Column:
    """Bound on the overlap: bits that differ stand for at least as many shingles that differ."""
    x, y = _of(left, "n_shingles"), _of(right, "n_shingles")
    return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & (
        _differing_bits(left, right) * (100 + percent) <= (x + y) * (100 - percent)
    )


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int):
    """Of ``pairs`` (a, b, left, right) those that link, staged.

    Texts are not shuffled: tasks make the arrays of the texts that pass a small filter, and
    only these arrays are.
    """
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bits = _filter_bits(ends.join(nodes.select("id", "source"), "id"))
    arrays = staged(
        docs.select(_filter_bit(), "text")
        .mapInArrow(_arrays(width, bits), "set_key binary, shingles binary")
        .select(F.xxhash64("set_key").alias("id"), "shingles")
    )
    first = arrays.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    second = arrays.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    links = staged(
        pairs.join(second, "b")
        .join(first, "a")
        .select("a", "b", "left", "right", "x", "y")
        .mapInArrow(_exact(percent), "a long, b long, left long, right long")
    )
    discard(arrays)
    return links


def _shared_tiles(docs: DataFrame, sets: DataFrame, nodes: DataFrame, width: int, percent: int):
    """(tile, id, home, needed, crowd) of the tiles in which several nodes meet, one of them at home; ``crowd`` is
    their number. Two visitors of a band meet in their own.

    A node that shares fewer tiles of a band than a partner would share with it has no partner there; so
    tiles that sets share by chance go.
    """
    settled = "max(home) OVER (PARTITION BY tile) AS settled"
    kinds = "tile long, source long, home boolean, needed short"
    met = (
        docs.select("source", "text")
        .mapInArrow(_tile_rows(width, percent), kinds)
        .selectExpr("*", "count(*) OVER (PARTITION BY tile) AS crowd", settled)
        .where("crowd > 1 AND settled")
        .select("tile", "source", "home", "needed")
    )
    node_of = sets.join(nodes.select("set_key", "id"), "set_key").select("source", "id").distinct()
    shared = (
        met.join(node_of, "source")
        .groupBy("tile", "id")
        .agg(F.max("home").alias("home"), F.min("needed").alias("needed"))
        .selectExpr("*", "count(*) OVER (PARTITION BY tile) AS crowd", settled)
        .where("crowd > 1 AND settled")
        .selectExpr("tile", "id", "home", "needed", "count(*) OVER (PARTITION BY id, home) AS many")
        .where("many >= needed")
    )
    return (
        shared.selectExpr(
            "tile", "id", "home", "needed", "count(*) OVER (PARTITION BY tile) AS crowd", settled
        )
        .where("crowd > 1 AND settled")
        .drop("settled")
    )


def _neighbours(rows: DataFrame, percent: int, turn: int) -> DataFrame:
    """(a, b, bits, left, right, stands_for): pairs of neighbours in a tile that may link, and their components.

    The nodes of a tile lie in a random order, another one at each ``turn``; a crowded tile is dealt into
    parts. Neighbours are compared where they lie, and only those that may link become rows. Each pair stands for as
    many pairs of its tiles as were not looked at for it.
    """
    part = F.pmod(F.xxhash64("id", F.lit(turn)), F.ceil(F.col("crowd") / BLOCK))
    by = Window.partitionBy("tile", part).orderBy(F.xxhash64(F.lit(turn), "id"), "id")
    x = F.struct("id", "component", "n_shingles", "bitmap")
    near = F.filter(
        F.col("others"),
        lambda y: (F.col("x")["component"] != y["component"]) & _may_link(F.col("x"), y, percent),
    )
    return (
        rows.select(
            x.alias("x"),
            F.array(*(F.lag(x, n).over(by) for n in range(1, REACH + 1))).alias("others"),
            (F.col("crowd") / (2 * REACH)).alias("stands_for"),
        )
        .select("x", F.explode(near).alias("y"), "stands_for")
        .withColumn("bits", _differing_bits("x", "y"))
        .groupBy(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .agg(
            F.any_value("bits").alias("bits"),
            F.any_value("x.component").alias("left"),
            F.any_value("y.component").alias("right"),
            F.sum("stands_for").alias("stands_for"),
        )
    )


def _closest(near: DataFrame) -> DataFrame:
    """(a, b, left, right): for each node its ``REACH`` closest pairs."""
    pair = F.struct("bits", "a", "b", "left", "right")
    return (
        near.select(F.explode(F.array("a", "b")).alias("id"), pair.alias("pair"))
        .groupBy("id")
        .agg(F.slice(F.sort_array(F.collect_list("pair")), 1, REACH).alias("pairs"))
        .select(F.explode("pairs").alias("pair"))
        .select("pair.a", "pair.b", "pair.left", "pair.right")
        .distinct()
    )


def _across(small: DataFrame, crowded: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(a, b, left, right): pairs that share as many tiles as either needs and may link; ``left`` and ``right`` are
    the nodes, too.

    In small tiles all pairs are counted, in crowded ones, block by block, those of different components whose bitmaps
    are close enough.
    """
    x, y = small.alias("x"), small.alias("y")
    met = x.join(
        y,
        (F.col("x.tile") == F.col("y.tile"))
        & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.home") | F.col("y.home")),
    ).selectExpr(*_PAIR)
    blocks = F.ceil(F.col("crowd") / BLOCK).cast("int")
    x = crowded.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).alias("x")
    y = crowded.withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("y")
    more = x.join(
        y,
        (F.col("x.tile") == F.col("y.tile"))
        & (F.col("x.block") == F.col("y.block"))
        & (F.col("x.id") < F.col("y.id"))
        & (F.col("x.home") | F.col("y.home"))
        & (F.col("x.component") != F.col("y.component"))
        & _may_link("x", "y", percent),
    ).selectExpr(*_PAIR)
    shared = (
        met.union(more)
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("shared"), F.max("needed").alias("needed"))
        .where("shared >= needed")
    )
    return (
        shared.join(known.alias("x"), F.col("a") == F.col("x.id"))
        .join(known.alias("y"), F.col("b") == F.col("y.id"))
        .where(_may_link("x", "y", percent))
        .select("a", "b", F.col("a").alias("left"), F.col("b").alias("right"))
    )


_PAIR = (
    "x.id AS a",
    "y.id AS b",
    "greatest(x.needed, y.needed) AS needed",
)


def _renamed(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """``rows`` with the names of the components they now belong to."""
    return (
        rows.join(joined, "component", "left")
        .withColumn("component", F.coalesce("smallest", "component"))
        .select(rows.columns)
    )


def _open(rows: DataFrame) -> DataFrame:
    """The rows of tiles that hold several components."""
    several = (
        rows.groupBy("tile")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low < high")
        .select("tile")
    )
    return rows.join(several, "tile", "left_semi")


def _grouped(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, source, text_key, n_shingles, set_key, component) for each row of ``docs``; empty sets have no
    component. Components are of sets: an id with several texts may have several."""
    spark, docs = docs.sparkSession, _with_source(docs)
    text_key = F.xxhash64("text").alias("text_key")
    sets = staged(docs.select("doc_id", "source", text_key, "text").mapInArrow(_set_rows(width), _SET_TYPES))
    nodes = staged(
        sets.where("n_shingles > 0")
        .groupBy("set_key")
        .agg(
            F.min("source").alias("source"),
            *(F.any_value(c).alias(c) for c in ("n_shingles", "bitmap")),
        )
        .withColumn("id", F.xxhash64("set_key"))
    )
    known = nodes.select("id", "n_shingles", "bitmap")
    rows = staged(
        _shared_tiles(docs, sets, nodes, width, percent).withColumn("component", F.col("id"))
    )
    # All pairs of a small tile are no more than CROWD / 2 for each of its rows, so rounds leave it out.
    found: list[DataFrame] = []
    crowded = staged(rows.where(F.col("crowd") > CROWD).join(known, "id"))
    bound = 2 * rows.count()
    while True:
        near = staged(_neighbours(crowded, percent, len(found)))
        expected = near.agg(F.sum("stands_for")).first()[0] or 0
        if expected <= bound:
            discard(near)
            break
        pairs = staged(_closest(near))
        found.append(_verified(docs, nodes, pairs, width, percent))
        tried, linked = pairs.count(), found[-1].count()
        discard(near, pairs)
        if 20 * linked <= tried:
            # Nearly all candidates only come close to the threshold; rounds would not make them fewer.
            break
        joined = components(found[-1].select(F.col("left").alias("a"), F.col("right").alias("b")))
        old, crowded = crowded, staged(_renamed(crowded, joined.toDF("component", "smallest")))
        discard(old)
    small = rows.where(F.col("crowd") <= CROWD)
    pairs = staged(_across(small, _open(crowded), known, percent), wide=True)
    found.append(_verified(docs, nodes, pairs, width, percent))
    placed = components(_all(spark, found))
    named = staged(_with_component(nodes.select("set_key", "id"), placed)).drop("id")
    discard(rows, crowded, pairs, *found)
    return staged(sets.drop("bitmap").join(named, "set_key", "left"))


def _all(spark: SparkSession, links: list[DataFrame]) -> DataFrame:
    """(a, b) of several tables of links."""
    every = spark.createDataFrame([], "a long, b long")
    for some in links:
        every = every.union(some.select("a", "b"))
    return every


def _with_component(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """``rows`` with the component of their node, which is the node itself where it has no link."""
    return (
        rows.join(placed, "id", "left")
        .withColumn("component", F.coalesce("component", "id"))
        .select(*rows.columns, "component")
    )


def _with_source(docs: DataFrame) -> DataFrame:
    """``docs`` with what a row's text is found by: its id, or the hash of the text where it has none."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.alias("doc_id"), F.coalesce(doc_id, F.xxhash64("text")).alias("source"), "text"
    )


def shingle_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets.
    """
    rows = _grouped(docs, width, percent)
    # The texts of one id are one document, so their components are one.
    several = (
        rows.where("doc_id IS NOT NULL AND component IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("component").alias("a"), F.max("component").alias("b"))
        .where("a < b")
    )
    ends = rows.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("component").alias("b"))
    joined = staged(components(ends.where("b IS NOT NULL")).toDF("component", "smallest"))
    rows = _renamed(rows, joined)
    least = (
        rows.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min("doc_id").alias("component_id"))
    )
    return (
        rows.join(least, "component", "left")
        .withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id")
    )


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without near duplicates: of each group of linked texts the first one stays.

    The first is the text with the smallest id; texts without an id come last, and between texts of one id the hash of
    the text decides, so the choice is the same in every run. Texts are judged each for itself: rows
    that share an id but hold texts that are not linked all stay. Of repeated rows (same id and text)
    one stays, the one with the smallest hash of all its columns. Empty texts are linked with nothing and stay, repeats
    with the same id apart.
    """
    names = docs.columns
    groups = _grouped(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "set_key", "text_key")
    first = (
        groups.where("component IS NOT NULL")
        .groupBy("component")
        .agg(F.min(order).alias("first"))
        .select("first.doc_id", "first.text_key")
    )
    empty = groups.where("n_shingles = 0 AND doc_id IS NOT NULL").select("doc_id", "text_key")
    many = groups.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows"))
    both = first.unionByName(empty.distinct())
    same_id = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id"))
    kept = staged(
        both.alias("l")
        .join(many.alias("r"), same_id & (F.col("l.text_key") == F.col("r.text_key")))
        .select("l.doc_id", "l.text_key", "rows")
    )

    def rows_of_kept(which: DataFrame) -> DataFrame:
        wanted = which.select(
            F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")
        )
        return docs.join(
            wanted,
            docs["doc_id"].cast("long").eqNullSafe(F.col("__id"))
            & (F.xxhash64(docs["text"]) == F.col("__key")),
            "left_semi",
        )

    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    once = (
        rows_of_kept(kept.where("rows > 1"))
        .select(
            F.col("doc_id").alias("__id"),
            F.xxhash64("text").alias("__key"),
            F.xxhash64(*(F.col(f"`{c}`") for c in names)).alias("__hash"),
            whole.alias("__row"),
        )
        .groupBy("__id", "__key")
        .agg(F.min_by("__row", "__hash").alias("__row"))
        .select("__row.*")
    )
    nameless = docs.where(F.col("doc_id").isNull() & ~_has_word(F.col("text")))
    return rows_of_kept(kept.where("rows = 1")).unionByName(once).unionByName(nameless)


def _has_word(text: F.Column) -> F.Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
