"""Thinning, exact distances and nearest seeds over images of any size: no task holds an image.

Thinning goes over square tiles. A pixel's fate in one step depends on its eight neighbours, so a tile that knows
``HALO`` pixels around it can go ``HALO`` steps before it must hear from its neighbours again; each round is one exchange of
rims. Distances and nearest seeds go in two keyed passes, along columns and then along rows: a task holds the seeds of
``BAND`` columns, then those of ``BAND`` rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.operators import kernels, raster
from weft.operators.raster import PIXEL
from weft.session import dealt, stored

#: Side of tiles, steps of thinning between two exchanges (a multiple of 4), rows or columns of one band.
TILE = 256
HALO = 16
BAND = 64

NEAR = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def tiled(mask: DataFrame, side: int) -> DataFrame:
    """(image, tr, tc, top, left, bits): the tiles of a mask that hold pixels; top, left: the image's least row and column."""
    kind = kernels._kind(mask, "image")
    corner = mask.groupBy("image").agg(F.min("row").alias("top"), F.min("col").alias("left"))
    at = mask.select(*PIXEL).filter("image is not null and row is not null and col is not null")
    at = at.withColumn("tr", F.floor(F.col("row") / side)).withColumn("tc", F.floor(F.col("col") / side))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        image, tr, tc = (k.as_py() for k in key)
        grid = np.zeros((side, side), bool)
        grid[rows["row"].to_numpy() - tr * side, rows["col"].to_numpy() - tc * side] = True
        return pa.table({"image": pa.array([image], rows.schema.field("image").type), "tr": pa.array([tr], pa.int64()), "tc": pa.array([tc], pa.int64()), "bits": [np.packbits(grid).tobytes()]})

    packed = at.groupBy("image", "tr", "tc").applyInArrow(pack, f"image {kind}, tr long, tc long, bits binary")
    return packed.join(corner, "image").select("image", "tr", "tc", F.col("top").cast("long").alias("top"), F.col("left").cast("long").alias("left"), "bits")


def pixels_of(tiles: DataFrame, side: int) -> DataFrame:
    """The pixels (image, row, col) of tiles."""

    def unpack(batches):
        for batch in batches:
            for one in (batch.slice(k, 1) for k in range(len(batch))):
                tr, tc, bits = (one.column(k)[0].as_py() for k in (1, 2, 3))
                r, c = np.nonzero(np.unpackbits(np.frombuffer(bits, np.uint8))[: side * side].reshape(side, side))
                image = one.column(0).take(pa.array(np.zeros(len(r), np.int64)))
                yield pa.RecordBatch.from_arrays([image, pa.array((r + tr * side).astype("i4")), pa.array((c + tc * side).astype("i4"))], ["image", "row", "col"])

    return tiles.select("image", "tr", "tc", "bits").mapInArrow(unpack, f"image {kernels._kind(tiles, 'image')}, row int, col int")


def _rims(tiles: DataFrame, side: int, halo: int) -> DataFrame:
    """Every tile for itself (nr = nc = 0), and its rims for the tiles at their other side; nr, nc: where the sender lies."""
    kind = kernels._kind(tiles, "image")

    def send(batches):
        for batch in batches:
            out = []
            for image, tr, tc, top, left, bits in zip(*(batch.column(k) for k in range(6)), strict=True):
                grid = np.unpackbits(np.frombuffer(bits.as_buffer(), np.uint8))[: side * side].reshape(side, side)
                part = {-1: slice(0, halo), 0: slice(0, side), 1: slice(side - halo, side)}
                for r, c in NEAR:
                    rim = grid[part[r], part[c]]
                    if (r, c) == (0, 0) or rim.any():
                        # what lies at this tile's lower side (r = 1) is above (nr = -1) the tile below
                        out.append((image, tr.as_py() + r, tc.as_py() + c, top.as_py(), left.as_py(), -r, -c, np.packbits(rim).tobytes()))
            columns = list(zip(*out, strict=True))
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary()]
            arrays = [pa.array([x.as_py() for x in columns[0]], kinds[0]), *(pa.array(x, k) for x, k in zip(columns[1:], kinds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, ["image", "tr", "tc", "top", "left", "nr", "nc", "bits"])

    return tiles.select("image", "tr", "tc", "top", "left", "bits").mapInArrow(send, f"image {kind}, tr long, tc long, top long, left long, nr int, nc int, bits binary")


def _round(tiles: DataFrame, side: int, halo: int, steps) -> DataFrame:
    """The tiles after ``halo`` steps, with ``changed``. steps(padded, row, col): the padded tile after them, in place."""
    kind = kernels._kind(tiles, "image")

    def settle(key: tuple, rows: pa.Table) -> pa.Table:
        image, tr, tc = (k.as_py() for k in key)
        padded = np.zeros((side + 2 * halo, side + 2 * halo), bool)
        place = {-1: slice(0, halo), 0: slice(halo, halo + side), 1: slice(halo + side, side + 2 * halo)}
        own = None
        for r in rows.to_pylist():
            part = padded[place[r["nr"]], place[r["nc"]]]
            part[:] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))[: part.size].reshape(part.shape)
            own = r if (r["nr"], r["nc"]) == (0, 0) else own
        field = rows.schema.field("image").type
        if own is None:
            return pa.table({"image": pa.array([], field), "tr": pa.array([], pa.int64()), "tc": pa.array([], pa.int64()), "top": pa.array([], pa.int64()), "left": pa.array([], pa.int64()), "bits": pa.array([], pa.binary()), "changed": pa.array([], pa.bool_())})
        alone, changed = rows.num_rows == 1, True
        while changed:
            before = padded[halo : halo + side, halo : halo + side].copy()
            steps(padded, tr * side - halo - own["top"], tc * side - halo - own["left"])
            after = padded[halo : halo + side, halo : halo + side]
            changed = bool((before != after).any())
            # nothing near ever comes back: a tile that hears of nobody goes on to its end
            if not alone:
                break
        return pa.table({"image": pa.array([image], field), "tr": pa.array([tr], pa.int64()), "tc": pa.array([tc], pa.int64()), "top": [own["top"]], "left": [own["left"]], "bits": [np.packbits(after).tobytes()], "changed": [changed]})

    schema = f"image {kind}, tr long, tc long, top long, left long, bits binary, changed boolean"
    return _rims(tiles, side, halo).groupBy("image", "tr", "tc").applyInArrow(settle, schema)


def thinned(mask: DataFrame, side: int = TILE, halo: int = HALO) -> DataFrame:
    """One-pixel lines of a mask: pixel for pixel what ``kernels.thin`` makes of each image as a whole.

    halo: a multiple of 4, at most ``side``. Images whose pixels fit a tile are thinned many at once, in one pass; for the others
    rounds go on until no tile changes, and each is written once.
    """
    if halo % 4 or not 0 < halo <= side:
        raise ValueError("halo must be a multiple of 4, and at most the tile's side")
    mask = mask.select(*PIXEL).filter("image is not null and row is not null and col is not null")
    span = lambda c: F.max(c) - F.min(c) < side
    fits = stored(mask.groupBy("image").agg((span("row") & span("col")).alias("fits")), "spans")
    large = fits.filter("not fits")
    if large.isEmpty():
        return _thinned_whole(mask)
    small = _thinned_whole(mask.join(large, "image", "left_anti"))
    return small.unionByName(_thinned_tiles(mask.join(large, "image", "left_semi"), side, halo))


def _thinned_whole(mask: DataFrame) -> DataFrame:
    """Images that fit a tile, many to a batch; one that a batch cuts waits for the next."""

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (held["image"] == held["image"].iloc[-1]).to_numpy()
            if not last.all():
                yield lines(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield lines(held)

    def lines(frame):
        image = frame["image"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], image[1:] != image[:-1]]))
        number = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(image))))
        k, row, col = kernels.thin_all(number, frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64))
        return pd.DataFrame({"image": image[first][k], "row": row.astype("i4"), "col": col.astype("i4")})

    return dealt(mask, "image").sortWithinPartitions("image").mapInPandas(run, f"image {kernels._kind(mask, 'image')}, row int, col int")


def _thinned_tiles(mask: DataFrame, side: int, halo: int) -> DataFrame:
    """As thinned, tile by tile."""

    def borders(grid, row, col):
        for k in range(halo):
            kernels.thin_step(grid, k % 2 == 0)

    def corners(grid, row, col):
        for k in range(halo):
            # of each two by two pixels one, counted from the image's first row and column
            kernels.corner_step(grid, (k // 2 % 2 - row - 1) % 2, (k % 2 - col - 1) % 2)

    tiles = stored(tiled(mask, side), "tiles")
    for steps in (borders, corners):
        while True:
            after = stored(_round(tiles, side, halo, steps), "thin")
            tiles = after.drop("changed")
            if after.filter("changed").isEmpty():
                break
    return pixels_of(tiles, side)


def lower_envelope(g: np.ndarray, scale: int) -> np.ndarray:
    """For each row of g and each place p of a row the q of the least g[q] + scale (p - q)^2; g is -1 where there is no parabola.

    All rows are swept together: one step a column adds its parabolas and takes back those that they hide. Values of one row
    must never be equal at a place for different q, unless either will do. Rows without any parabola give -1.
    """
    rows, n = g.shape
    at = np.zeros((rows, n), np.int64)
    cut = np.zeros((rows, n + 1), np.int64)
    top = np.full(rows, -1)
    line = np.arange(rows)
    for q in range(n):
        todo = line[g[:, q] >= 0]
        while len(todo):
            first = top[todo] < 0
            some = todo[~first]
            p = at[some, top[some]]
            # q wins over p from this place on
            begin = (scale * (q * q - p * p) + g[some, q] - g[some, p]) // (2 * scale * (q - p)) + 1
            hidden = begin <= cut[some, top[some]]
            push = np.concatenate([todo[first], some[~hidden]])
            start = np.concatenate([np.full(int(first.sum()), -(1 << 40)), begin[~hidden]])
            top[push] += 1
            at[push, top[push]] = q
            cut[push, top[push]] = start
            todo = some[hidden]
            top[todo] -= 1
    out = np.full((rows, n), -1)
    place = np.arange(n)
    for r in line[top >= 0]:
        out[r] = at[r, np.searchsorted(cut[r, : top[r] + 1], place, "right") - 1]
    return out


def nearest(mask: DataFrame, seeds: DataFrame, band: int = BAND) -> DataFrame:
    """(image, row, col, seed, d2): the nearest seed of each mask pixel at any distance, the least of equals, and d2 squared.

    seeds: image, row, col, seed (a whole number; the least counts where a pixel has several). An image without seeds has NULL.
    Pixels that occur twice in the mask come out twice. Rows and columns are 0 to 2^20 - 1. Images that fit a band, seeds and all, are
    gone through many at once.
    """
    some = seeds.select(*PIXEL, F.col("seed").cast("long").alias("seed")).filter("image is not null and row is not null and col is not null and seed is not null")
    some = stored(some, "seeds")
    at = mask.select(*PIXEL)
    span = lambda c: (F.count(c) == F.count("*")) & (F.max(c) - F.min(c) < band)
    fits = at.unionByName(some.select(*PIXEL)).groupBy("image").agg((F.col("image").isNotNull() & span("row") & span("col")).alias("fits"))
    fits = stored(fits, "spans")
    large = fits.filter("not fits")
    if large.isEmpty():
        return _nearest_whole(at, some)
    small = fits.filter("fits").select("image")
    part = lambda rows, how: rows.join(small, "image", how)
    return _nearest_whole(part(at, "left_semi"), part(some, "left_semi")).unionByName(_nearest_bands(part(at, "left_anti"), part(some, "left_anti"), band))


def _nearest_whole(mask: DataFrame, seeds: DataFrame) -> DataFrame:
    """As nearest: images that fit a band, many to a batch; one that a batch cuts waits for the next."""

    def run(frames):
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = (held["image"] == held["image"].iloc[-1]).to_numpy()
            if not last.all():
                yield lines(held[~last])
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield lines(held)

    def lines(frame):
        image, asks = frame["image"].to_numpy(), frame["asks"].to_numpy(bool)
        number = np.cumsum(np.concatenate([[False], image[1:] != image[:-1]]))
        row, col = frame["row"].to_numpy(np.int64), frame["col"].to_numpy(np.int64)
        seed, d2 = kernels.nearest_all(number, row, col, frame["seed"].to_numpy(np.int64), asks)
        whole = lambda x: pd.arrays.IntegerArray(x, d2 < 0)
        return pd.DataFrame({"image": image[asks], "row": row[asks].astype("i4"), "col": col[asks].astype("i4"), "seed": whole(seed), "d2": whole(d2)})

    rows = mask.withColumns({"seed": F.lit(0).cast("long"), "asks": F.lit(True)}).unionByName(seeds.withColumn("asks", F.lit(False)))
    return dealt(rows, "image").sortWithinPartitions("image").mapInPandas(run, f"image {kernels._kind(mask, 'image')}, row int, col int, seed long, d2 long")


def _nearest_bands(mask: DataFrame, seeds: DataFrame, band: int) -> DataFrame:
    """As nearest, in bands of columns, then of rows."""
    kind = kernels._kind(mask, "image")
    far = lambda c: F.floor(F.col(c) / band)
    some = seeds.withColumn("cb", far("col"))
    at = mask.withColumn("rb", far("row"))
    bands = at.select("image", "rb").distinct()
    # the bands of rows that a band of columns must tell: as many as an image has tiles
    meets = some.select("image", "cb").distinct().join(bands, "image").select(F.col("image").alias("of"), F.col("cb").alias("block"), "rb")

    def columns(key: tuple, mine: pa.Table, wanted: pa.Table) -> pa.Table:
        image, cb = (k.as_py() for k in key)
        row, col, seed = (mine[c].to_numpy().astype(np.int64) for c in ("row", "col", "seed"))
        col = col - cb * band
        by = np.lexsort((-seed, col, row))  # the least of a pixel is written last
        row, col, seed = row[by], col[by], seed[by]
        parts = np.sort(wanted["rb"].to_numpy())
        if not len(parts):  # an image without mask
            return pa.table({"image": pa.array([], mine.schema.field("image").type), "rb": pa.array([], pa.int64()), "cb": pa.array([], pa.int64()), "distance": pa.array([], pa.binary()), "seed": pa.array([], pa.binary())})
        lo, hi = min(int(row.min()), int(parts[0]) * band), max(int(row.max()) + 1, (int(parts[-1]) + 1) * band)
        place = np.full((hi - lo, band), -1, np.int64)
        place[row - lo, col] = row - lo
        value = np.zeros((hi - lo, band), np.int64)
        value[row - lo, col] = seed
        here = np.arange(hi - lo)[:, None]
        up = np.maximum.accumulate(place, axis=0)
        down = np.minimum.accumulate(np.where(place < 0, 1 << 40, place)[::-1], axis=0)[::-1]
        above = np.where(up < 0, 1 << 40, here - up)
        below = down - here
        reach = lambda x: np.take_along_axis(value, np.clip(x, 0, hi - lo - 1), axis=0)
        upper, lower = reach(up), reach(down)
        take = (below < above) | ((below == above) & (lower < upper))
        distance, seed = np.where(take, below, above), np.where(take, lower, upper)
        distance = np.where(distance >= 1 << 30, -1, distance).astype("i4")
        cuts = [slice(int(b) * band - lo, (int(b) + 1) * band - lo) for b in parts]
        return pa.table({"image": pa.array([image] * len(parts), mine.schema.field("image").type), "rb": pa.array(parts, pa.int64()), "cb": pa.array([cb] * len(parts), pa.int64()), "distance": [distance[c].tobytes() for c in cuts], "seed": [seed[c].tobytes() for c in cuts]})

    def lines(key: tuple, mine: pa.Table, told: pa.Table) -> pa.Table:
        rb = key[1].as_py()
        row, col = mine["row"].to_numpy().astype(np.int64), mine["col"].to_numpy().astype(np.int64)
        n = len(row)
        seed, d2 = np.zeros(n, np.int64), np.full(n, -1)
        if len(told) and n:
            cb = told["cb"].to_numpy()
            left = int(min(cb.min(), col.min() // band)) * band
            width = int(max(cb.max(), col.max() // band) + 1) * band - left
            distance, value = np.full((band, width), -1, np.int64), np.zeros((band, width), np.int64)
            for k, block in enumerate(cb):
                place = slice(int(block) * band - left, (int(block) + 1) * band - left)
                distance[:, place] = np.frombuffer(told["distance"][k].as_buffer(), "i4").reshape(band, band)
                value[:, place] = np.frombuffer(told["seed"][k].as_buffer(), "i8").reshape(band, band)
            kinds, rank = np.unique(value, return_inverse=True)
            scale = len(kinds)
            # distance first, then seed: two parabolas are equal at a place only if both are
            g = np.where(distance < 0, -1, scale * distance * distance + rank.reshape(value.shape))
            used = np.unique(row - rb * band)
            owner = np.full((band, width), -1)
            owner[used] = lower_envelope(g[used], scale)
            q = owner[row - rb * band, col - left]
            found = q >= 0
            d2[found] = distance[(row - rb * band)[found], q[found]] ** 2 + (col[found] - left - q[found]) ** 2
            seed[found] = value[(row - rb * band)[found], q[found]]
        none = d2 < 0
        return pa.table({"image": mine["image"], "row": pa.array(row.astype("i4")), "col": pa.array(col.astype("i4")), "seed": pa.array(seed, mask=none), "d2": pa.array(d2, mask=none)})

    told = some.groupBy("image", "cb").cogroup(meets.groupBy("of", "block")).applyInArrow(columns, f"image {kind}, rb long, cb long, distance binary, seed binary")
    return at.groupBy("image", "rb").cogroup(told.groupBy("image", "rb")).applyInArrow(lines, f"image {kind}, row int, col int, seed long, d2 long")


def distances(mask: DataFrame, height: int, width: int, band: int = BAND) -> DataFrame:
    """Squared distance of each mask pixel to the background inside the frame; NULL where an image has none.

    The nearest background pixel always touches the mask, so only such ones are seeds.
    """
    rim = raster.minus(raster.dilate(mask, raster.square(1), height, width), mask)
    return nearest(mask, rim.withColumn("seed", F.lit(0)), band).select(*PIXEL, "d2")
