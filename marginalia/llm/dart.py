"""Near-duplicates by DartMinHash over weighted word shingles.

The weight of a shingle is how often it occurs, so an element is a stack of unit cells. Darts arrive in
every cell as a Poisson process whose gaps are hashes of the cell and the number of the dart; a text
keeps the darts in its cells up to a rank bound at which it expects k log k + 2 k of them. Each dart is
hashed to one of k coordinates, and the earliest of a coordinate is its value. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. Work is cells plus darts, not
cells times coordinates. Bands of coordinates are joined, and every link is verified exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import bytes_of, fresh_prefix, map_batches, mix64
from marginalia.llm.components import components
from marginalia.session import staged

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)  # odd
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = mix64(np.arange(256, dtype=np.uint64) * _U(0xD6E8FEB86659FD93) + _U(1))
_STEP = _U(0xA0761D6478BD642F)
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20


@dataclass(frozen=True)
class DartOptions:
    shingle: int = 5
    similarity: float = 0.8
    rows: int = 5  # coordinates of a band; a pair at 0.8 is missed by all bands with probability 1.3e-7
    bands: int = 40
    small: int = 16  # buckets of up to so many texts are compared as rows, larger ones in tiles; results are alike
    tile_rows: int = 64  # texts of either side that meet in a tile

    @property
    def k(self) -> int:
        return self.rows * self.bands


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (text between white space) of a batch, and the row it is in."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power = np.full(len(raw), _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_LETTER[raw] * power, out=total[1:])
    back = np.full(len(raw), _BACK, np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    value = mix64((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _STEP)
    return value, np.searchsorted(bounds, starts, side="right") - 1


def cells_of(raw: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells of every text, ordered by row and hash, and the border of each row in them.

    The c-th occurrence of a shingle is a cell of its own, so the Jaccard similarity of two sets of
    cells is the weighted one of the shingles. A text of fewer words than a shingle is one shingle.
    """
    words, row = word_hashes(raw, bounds)
    rows = len(bounds) - 1
    counts = np.bincount(row, minlength=rows)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    take = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    at = np.repeat(firsts - np.concatenate([[0], np.cumsum(take)[:-1]]), take) + np.arange(take.sum())
    owner = np.repeat(np.arange(rows), take)
    span = np.minimum(counts, shingle)[owner]
    value = span.astype(np.uint64)
    for k in range(shingle):
        more = span > k
        value[more] = mix64(value[more] * _STEP + words[at[more] + k])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(fresh)
    again = (np.arange(len(value)) - np.repeat(heads, np.diff(np.append(heads, len(value))))).astype(np.uint64)
    value = np.where(again > 0, mix64(value + again * _BASE), value)
    order = np.lexsort((value, owner))
    return value[order], np.concatenate([[0], np.cumsum(take)])


def signatures(cells: np.ndarray, borders: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """The k earliest darts of every row of cells, as a (rows, k) array; rows without cells are 0.

    `weights`, where given, is the filled part (0 to 1] of each cell: a dart above it misses.
    """
    rows = len(borders) - 1
    sizes = np.diff(borders)
    out = np.zeros((rows, k), np.uint64)
    owner = np.repeat(np.arange(rows), sizes)
    mass = sizes.astype(float) if weights is None else np.bincount(owner, weights, rows)
    bound = (k * np.log(k) + 2 * k) / np.maximum(mass, 1e-12)
    open_rows = sizes > 0
    while open_rows.any():
        live = np.flatnonzero(open_rows[owner])
        rank, number = np.zeros(len(live)), 0
        darts, ranks, owners = [], [], []
        while len(live):
            number += 1
            dart = mix64(cells[live] + _U(number * int(_BASE) & (1 << 64) - 1))
            rank = rank - np.log1p(-(dart >> _U(11)).astype(float) * 2.0**-53)
            keep = rank <= bound[owner[live]]
            live, rank, dart = live[keep], rank[keep], dart[keep]
            hit = slice(None) if weights is None else (mix64(dart + _STEP) >> _U(11)).astype(float) * 2.0**-53 < weights[live]
            darts.append(dart[hit])
            ranks.append(rank[hit])
            owners.append(owner[live][hit])
        dart, rank, where = np.concatenate(darts), np.concatenate(ranks), np.concatenate(owners)
        dart = mix64(dart ^ _STEP)
        slot = where * k + (dart % _U(k)).astype(np.int64)
        late_first = np.argsort(-rank, kind="stable")
        flat = np.zeros(rows * k, np.uint64)
        flat[slot[late_first]] = dart[late_first] | _U(1)
        done = open_rows & (flat.reshape(rows, k) != 0).all(axis=1)
        out[done] = flat.reshape(rows, k)[done]
        open_rows &= ~done
        bound[open_rows] *= 2
    return out


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, -1)
    value = np.tile(mix64(np.arange(bands, dtype=np.uint64) + _U(7)), (len(signature), 1))
    for r in range(parts.shape[2]):
        value = mix64(value * _STEP + parts[:, :, r])
    return value


def _chunks(bounds: np.ndarray) -> list[tuple[int, int]]:
    """Row ranges of at most CHUNK bytes, or of one row."""
    out, at = [], 0
    while at < len(bounds) - 1:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK, side="right")) - 1)
        out.append((at, to))
        at = to
    return out


SIGNED = "doc_id bigint, mark string, n bigint, print_a bigint, print_b bigint, bands array<bigint>, sketch binary"
PRINTS = ["n", "print_a", "print_b"]


def _prints(cells: np.ndarray, borders: np.ndarray) -> list[np.ndarray]:
    """Number of cells of every row and two sums of their hashes: equal for equal sets of cells."""
    sums = [np.concatenate([[_U(0)], np.cumsum(mix64(cells + salt))]) for salt in (_STEP, _BASE)]
    return [np.diff(borders), *((s[borders[1:]] - s[borders[:-1]]).view(np.int64) for s in sums)]


def _mark(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.md5(F.coalesce(text, F.lit("")))


def signed_texts(docs: DataFrame, options: DartOptions) -> DataFrame:
    """Cells counted, a 128-bit print of them, band hashes and one byte per coordinate, of every text."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, bounds = bytes_of(batch.column("text"))
        prints, bands, sketches = [], [], []
        for a, b in _chunks(bounds):
            cells, borders = cells_of(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], options.shingle)
            signature = signatures(cells, borders, options.k)
            prints.append(np.stack(_prints(cells, borders)))
            bands.append(band_hashes(signature, options.bands).view(np.int64))
            sketches.append((signature >> _U(32)).astype(np.uint8))
        marks = np.concatenate(sketches)
        offsets = np.arange(len(batch) + 1, dtype=np.int32)
        arrays = [
            batch.column("doc_id"), batch.column("mark"), *map(pa.array, np.hstack(prints)),
            pa.ListArray.from_arrays(offsets * options.bands, pa.array(np.concatenate(bands).ravel())),
            pa.array([m.tobytes() for m in marks], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "mark", *PRINTS, "bands", "sketch"])

    texts = docs.select("doc_id", _mark(F.col("text")).alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(texts, work, SIGNED)


def _cell_rows(texts: DataFrame, options: DartOptions) -> DataFrame:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw, bounds = bytes_of(batch.column("text"))
        out: list[bytes] = []
        for a, b in _chunks(bounds):
            cells, borders = cells_of(raw[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], options.shingle)
            out += [cells[x:y].tobytes() for x, y in zip(borders[:-1], borders[1:], strict=True)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in KEY), pa.array(out, pa.binary())], names=[*KEY, "cells"])

    return map_batches(texts, work, "id_null boolean, id_key bigint, mark string, cells binary")


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two ascending arrays of distinct cells."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0.0
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


def _likely(pairs: DataFrame, reps: DataFrame, options: DartOptions) -> DataFrame:
    """Pairs that can reach the similarity: by their numbers of cells, and by their sketches.

    The bound on the counts is exact. The sketch bound lies six standard deviations below the
    agreement expected at the similarity.
    """
    side = reps.select("rep", "n", "sketch")
    rows = pairs.join(side.toDF("a", "n_a", "sketch_a"), "a").join(side.toDF("b", "n_b", "sketch_b"), "b")
    rows = rows.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(options.similarity - 1e-9))
    s, k = options.similarity, options.k
    least = s * k - 6 * np.sqrt(k * s * (1 - s))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, k) for c in ("sketch_a", "sketch_b"))
        return batch.select(["a", "b"]).filter(pa.array((one == two).sum(axis=1) >= least))

    return map_batches(rows.select("a", "b", "sketch_a", "sketch_b"), work, "a bigint, b bigint")


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, options: DartOptions) -> DataFrame:
    """The pairs (a, b) whose exact weighted Jaccard similarity reaches the bound, staged."""
    pairs = staged(pairs, "dart-pairs")
    cells = _cells_for(staged(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "dart-ids"), reps, docs, options)
    rows = pairs.join(cells.toDF("b", "cells_b"), "b").join(cells.toDF("a", "cells_a"), "a")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ones, twos = batch.column("cells_a"), batch.column("cells_b")
        views = (tuple(np.frombuffer(v.as_buffer(), np.uint64) for v in pair) for pair in zip(ones, twos, strict=True))
        value = np.array([weighted_jaccard(a, b) for a, b in views])
        return batch.select(["a", "b"]).append_column("similarity", pa.array(value)).filter(pa.array(value >= options.similarity))

    return staged(map_batches(rows.select("a", "b", "cells_a", "cells_b"), work, "a bigint, b bigint, similarity double"), "dart-links")


#: What tells the texts of a table apart, in columns that are never null: an id, whether it is none, and the text's mark.
KEY = ["id_null", "id_key", "mark"]


def _key(mark: Column) -> list[Column]:
    return [F.col("doc_id").isNull().alias("id_null"), F.coalesce("doc_id", F.lit(0)).alias("id_key"), mark.alias("mark")]


def _cells_for(ids: DataFrame, reps: DataFrame, docs: DataFrame, options: DartOptions) -> DataFrame:
    """(rep, cells) of the representatives named in `ids` (rep), staged.

    Texts are looked up by their ids alone, which are narrow enough to be broadcast for long; their cells are then
    joined by the whole key, by which a text that repeats is dropped without a further shuffle.
    """
    wanted = staged(reps.join(ids, "rep", "left_semi").select("rep", "some.*"), "dart-wanted")
    named = staged(wanted.select("id_null", "id_key"), "dart-ids")
    texts = docs.select(*_key(_mark(F.col("text"))), F.coalesce("text", F.lit("")).alias("text")).join(named, ["id_null", "id_key"], "left_semi")
    return staged(_cell_rows(texts, options).join(wanted, KEY).dropDuplicates(KEY).select("rep", "cells"), "dart-cells")


def _arena_links(members: DataFrame, reps: DataFrame, labels: DataFrame, docs: DataFrame, options: DartOptions) -> DataFrame:
    """Links within large buckets whose texts are not of one component yet, without a row for each pair.

    Texts that meet in such buckets form an arena. Its texts that are not of its largest component are cut into
    chunks, and so are those that are; a tile compares a chunk of the former with a chunk of either. So no tile is
    built within the largest component, and an outlier among very many near copies costs one copy of them. In a tile all
    pairs that share a band are compared: by counts, by sketch, then exactly. A pair that the tile has
    already connected is skipped, so a tile gives fewer links than it has texts.
    """
    edges = members.groupBy("bucket").agg(F.min("rep").alias("b")).join(members.select("bucket", F.col("rep").alias("a")), "bucket")
    arenas = staged(components(edges.select("a", "b")).toDF("rep", "arena"), "dart-arenas")
    cells = _cells_for(arenas.select("rep"), reps, docs, options)
    sized = staged(
        arenas.join(reps.select("rep", "bands", "sketch"), "rep").join(labels, "rep").join(cells, "rep"), "dart-arena-rows"
    )
    shares = sized.groupBy("arena", "label").agg(F.count("*").alias("texts"), F.sum(F.length("cells")).alias("bytes"))
    sides = shares.groupBy("arena").agg(
        F.max_by("label", F.struct("texts", "label")).alias("main"), F.max("texts").alias("main_texts"), F.max_by("bytes", F.struct("texts", "label")).alias("main_bytes"),
        F.sum("texts").alias("texts"), F.sum("bytes").alias("bytes"),
    )

    def chunks(texts: Column, size: Column) -> Column:
        return F.greatest(F.ceil(texts / options.tile_rows), F.ceil(size / (16 << 20))).cast("int")

    sides = sides.select(
        "arena", "main", chunks(F.col("main_texts"), F.col("main_bytes")).alias("mains"),
        chunks(F.col("texts") - F.col("main_texts"), F.col("bytes") - F.col("main_bytes")).alias("others"),
    ).where("others > 0")
    rows = sized.join(staged(sides, "dart-chunks"), "arena")
    is_main = F.col("label") == F.col("main")
    place = F.xxhash64("rep")
    own = F.when(is_main, F.pmod(place, F.col("mains"))).otherwise(F.col("mains") + F.pmod(place, F.col("others")))
    rows = rows.withColumn("own", own.cast("int"))
    # Chunks of the largest component come first; they meet only those behind them.
    met = F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    tiles = F.transform(met, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    rows = rows.select("arena", "own", "rep", "label", "bands", "sketch", "cells", F.explode(tiles).alias("t")).select("*", "t.i", "t.j").drop("t")
    least = options.similarity * options.k - 6 * np.sqrt(options.k * options.similarity * (1 - options.similarity))

    def work(key: tuple, group: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        own, rep, label = (np.asarray(group.column(c)) for c in ("own", "rep", "label"))
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
        cells = [np.frombuffer(c, np.uint64) for c in group.column("cells").to_pylist()]
        size = np.array([len(c) for c in cells])
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        root = {x: x for x in label.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        found: list[tuple[int, int, float]] = []
        agree = np.zeros((len(left), len(right)), np.int64)
        for row, x in enumerate(left):
            agree[row] = (sketch[right] == sketch[x]).sum(axis=1)
            short, long = np.minimum(size[right], size[x]), np.maximum(size[right], size[x])
            near = (bands[right] == bands[x]).any(axis=1) & (short >= long * (options.similarity - 1e-9)) & (label[right] != label[x])
            agree[row][~near | (rep[right] <= rep[x] if i == j else False)] = -1
        one, two = np.nonzero(agree >= least)
        for at in np.argsort(-agree[one, two], kind="stable"):
            x, y = int(left[one[at]]), int(right[two[at]])
            a, b = find(int(label[x])), find(int(label[y]))
            if a != b and (value := weighted_jaccard(cells[x], cells[y])) >= options.similarity:
                root[max(a, b)] = min(a, b)
                found.append((int(min(rep[x], rep[y])), int(max(rep[x], rep[y])), value))
        ones, twos, values = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"a": pa.array(ones, pa.int64()), "b": pa.array(twos, pa.int64()), "similarity": pa.array(values, pa.float64())})

    return staged(rows.groupBy("arena", "i", "j").applyInArrow(work, "a bigint, b bigint, similarity double"), "dart-arena-links")


def _classes(docs: DataFrame, options: DartOptions) -> tuple[DataFrame, DataFrame]:
    """Staged: every row signed; and for every print that a text has, its component and the smallest id of that."""
    every = staged(signed_texts(docs, options), "dart-signed")
    reps = every.where("n > 0").groupBy(*PRINTS).agg(F.min(F.struct(*_key(F.col("mark")))).alias("some"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    reps = staged(reps.withColumn("rep", F.monotonically_increasing_id()), "dart-reps")
    entries = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = staged(entries.join(staged(shared, "dart-buckets"), "bucket"), "dart-members")
    star = staged(members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct(), "dart-star")
    links = _verified(_likely(star, reps, options), reps, docs, options)
    first = components(links)
    named = members.join(first.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", "size", "rep", F.coalesce("component", "rep").alias("label"))
    named = staged(named, "dart-named")
    mixed = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    rest = staged(named.join(staged(mixed, "dart-mixed"), "bucket"), "dart-rest")
    small = rest.where(F.col("size") <= options.small).select("bucket", "rep", "label")
    one, two = small.toDF("bucket", "a", "label_a"), small.toDF("bucket", "b", "label_b")
    across = one.join(two, "bucket").where("a < b AND label_a <> label_b").select("a", "b").distinct()
    across = across.join(star, ["a", "b"], "left_anti")
    more = _verified(_likely(across, reps, options), reps, docs, options)
    large = rest.where(F.col("size") > options.small)
    labels = large.select("rep", "label").distinct()
    tiled = _arena_links(large.select("bucket", "rep"), reps, labels, docs, options)
    ends = [found.select("a", "b") for found in (links, more, tiled)]
    groups = components(ends[0].unionByName(ends[1]).unionByName(ends[2])).withColumnRenamed("id", "rep")
    least_id = F.when(~F.col("some.id_null"), F.col("some.id_key")).alias("least_id")
    parts = reps.select(*PRINTS, "rep", least_id).join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = staged(parts, "dart-parts")
    least = parts.groupBy("component").agg(F.min("least_id").alias("class_id"))
    return every, staged(parts.join(least, "component").select(*PRINTS, "component", "class_id"), "dart-classes")


def near_duplicates(docs: DataFrame, options: DartOptions = DartOptions()) -> DataFrame:
    """(doc_id, class_id, n_cells) of every row: the class is the smallest id reachable by links.

    Texts with equal cells are one representative; copies are never paired. In each bucket of a band
    every representative is compared with the smallest one first, and the verified links are joined to
    components. Then all pairs of a bucket that still lie in different components are compared: those
    of small buckets as rows, whose number is bounded by the bucket's size, those of large ones in
    tiles. So no link between different texts is lost to the shortcut. Rows go by their text, not by their id:
    rows that repeat share a class, several texts of one id have classes of their own, and a row without an id has
    the class of its text, null if no row of the class has an id. A text without words (null, empty, blank) is a
    class of its own. An empty table gives no rows; a text of any length is hashed whole by one task; only doc_id
    and text are read.
    """
    every, classes = _classes(docs, options)
    linked = every.where("n > 0").select("doc_id", *PRINTS).join(classes, PRINTS).select("doc_id", "class_id", F.col("n").alias("n_cells"))
    alone = every.where("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("n").alias("n_cells"))
    return linked.unionByName(alone)


def first_of_each(docs: DataFrame, options: DartOptions = DartOptions()) -> DataFrame:
    """One row of `docs` for every class, in all its columns: that with the smallest id, a null id being last.

    Of several texts of that id in the class the one with the smallest digest stays, and of rows that repeat it
    one. Rows without words all stay. Only rows that repeat a text that stays are shuffled for it.
    """
    every, classes = _classes(docs, options)
    rows = staged(every.where("n > 0").join(classes, PRINTS).groupBy("component", *_key(F.col("mark"))).count(), "dart-texts")
    first = rows.groupBy("component").agg(F.min(F.struct(*KEY)).alias("first"))
    rows = rows.join(first, "component").select(*KEY, "count", (F.struct(*KEY) == F.col("first")).alias("stays"))
    blank = every.where("n = 0").select(*_key(F.col("mark"))).distinct()
    rows = staged(rows.unionByName(blank.select("*", F.lit(0).cast("bigint").alias("count"), F.lit(True).alias("stays"))), "dart-stays")
    # Most ids have one text, and ids alone are narrow; only ids of which some texts stay are told apart by text.
    ids = rows.groupBy("id_null", "id_key").agg(F.max("stays").alias("some"))
    p = fresh_prefix(docs.columns)
    on = [f"{p}{c}" for c in KEY]

    def named(found: DataFrame, name: str, many: int) -> DataFrame:
        return staged(found.select(*[F.col(c).alias(n) for c, n in zip(KEY[:many], on, strict=False)]), name)

    gone = named(ids.where("NOT some"), "dart-gone", 2)
    partly = named(rows.where("NOT stays").join(ids.where("some"), ["id_null", "id_key"], "left_semi"), "dart-partly", 3)
    repeated = named(rows.where("stays AND count > 1"), "dart-repeated", 3)
    keyed = docs.select("*", *[c.alias(name) for c, name in zip(_key(_mark(F.col("text"))), on, strict=True)]).join(gone, on[:2], "left_anti")
    if not partly.isEmpty():
        keyed = keyed.join(partly, on, "left_anti")
    if not repeated.isEmpty():
        once = keyed.join(repeated, on, "left_semi").dropDuplicates(on)
        keyed = keyed.join(repeated, on, "left_anti").unionByName(once)
    return keyed.select(*docs.columns)
