"""Station-to-station comparison.

Joining all stations of a day with each other would emit every pair for every day. Instead stations fall into blocks, and
the days of a block over four years are packed once into a tile: a matrix of stations by days, of which the known days are
kept. Tiles, not days, travel to the cells where they meet other tiles; counts and sums of all pairs of two tiles are matrix
products, and only one finished row per station pair leaves a task. All sums are integers below 2 ** 53, so the result does
not depend on how the work was split.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grading import severity_of
from ..functions.numeric import tenths
from ..session import ship_package

#: Stations of a block, about.
BLOCK_STATIONS = 64
#: Years of a tile.
TILE_YEARS = 4
#: Blocks along one side of a cell, at most: a tile is sent to every cell of its row and column. With fewer blocks cells are
#: smaller, so that there are about CELLS a side.
CELL_BLOCKS = 32
CELLS = 10
#: Stations on either side of what is multiplied at once, about.
SIDE_STATIONS = 512
#: Periods that are multiplied at once, and sides that a task keeps open for their next meeting, at most.
TOGETHER = 2
HELD_SIDES = 8
#: Days of a station whose gaps are taken at once, about.
GAP_ROWS = 256
#: Pairs of one task of an ordered result, about, and pairs whose order is looked at for each task.
ORDERED_PAIRS = 1_500_000
LOOKED_AT = 100
DAYS = TILE_YEARS * 366
UNKNOWN = np.iinfo(np.int32).min
#: Whole numbers up to here are exact in a matrix product of doubles.
EXACT64 = 1 << 53
_TILE_SCHEMA = "team string, block int, blocks int, period int, ids array<string>, low int, high int, known binary, temps binary, grades binary"
_PAIR_SCHEMA = (
    "station_a string, station_b string, station_a_name string, station_b_name string, compared_days bigint, "
    "avg_temp_diff_f double, max_temp_diff_f double, score_disagree_days bigint, pct_disagree double, temp_correlation double"
)
#: Pairs that a cell gathers before it packs them.
RUN_PAIRS = 1_500_000
#: Whole numbers of a pair on its way: places of its stations, days, tenths of a degree, thousandths. A missing correlation is
#: NO_VALUE thousandths.
_WHOLE = ["a", "b", "n", "avg", "widest", "differ", "corr"]
NO_VALUE = 2000


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers of at least 0, in as few bytes each as they need, byte by byte and compressed."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    planes = np.ascontiguousarray(values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T).tobytes()
    return bytes([kind.itemsize]) + len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _opened(packed: bytes) -> np.ndarray:
    size, count = packed[0], int.from_bytes(packed[1:9], "little")
    planes = np.frombuffer(pa.decompress(packed[9:], size * count, "zstd", asbytes=True), np.uint8).reshape(size, count)
    return np.ascontiguousarray(planes.T).view(f"u{size}").ravel()


def _tile(days: pa.Table) -> pa.Table:
    """One row: the days of a block over TILE_YEARS years, known ones packed and compressed."""
    coded = days["station_id"].combine_chunks().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.unify_dictionaries().combine_chunks()
    rows = coded.indices.to_numpy()
    temps = np.full((len(coded.dictionary), DAYS), UNKNOWN, np.int32)
    grades = np.zeros(temps.shape, np.int8)
    columns = days["day"].to_numpy()
    temps[rows, columns] = days["t"].to_numpy()
    grades[rows, columns] = days["sev"].to_numpy()
    known = temps != UNKNOWN
    values = temps[known].astype(np.int64)
    low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    head = {c: days[c][:1] for c in ("team", "block", "blocks", "period")}
    packed = {"known": np.packbits(known), "temps": values - low, "grades": grades[known]}
    return pa.table(
        head
        | {"ids": pa.array([coded.dictionary.to_pylist()], pa.list_(pa.string())), "low": pa.array([low], pa.int32()), "high": pa.array([high], pa.int32())}
        | {c: pa.array([_squeezed(v)], pa.binary()) for c, v in packed.items()}
    )


class Days(NamedTuple):
    """Days of a cell that are looked at together: periods, the columns of them that any station knows, and what all its
    temperatures lie between."""

    periods: list[int]
    columns: np.ndarray
    low: int
    span: int


class Side:
    """Known days of some stations, and the forms in which they are multiplied, made when they are asked for. Temperatures
    count from the lowest of the cell, which changes neither gaps nor what a correlation is made of, and are 0 where unknown."""

    def __init__(self, temps: np.ndarray, known: np.ndarray, grades: np.ndarray, step: int):
        self.temps, self.known, self.grades, self.step = temps, known, grades, step

    def afresh(self) -> Side:
        """The same days without the forms made of them, which take ten times as much memory."""
        return Side(self.temps, self.known, self.grades, self.step)

    @cached_property
    def counted(self) -> np.ndarray:
        return self.known.astype(np.float32)

    @cached_property
    def graded(self) -> np.ndarray:
        return (self.grades > 0).astype(np.float32)

    @cached_property
    def whole(self) -> bool:
        """A grade on every known day."""
        return bool(((self.grades > 0) == self.known).all())

    def _of_grades(self, *columns: tuple[int, int, int]) -> np.ndarray:
        one = [(self.grades == g).astype(np.float32) for g in (1, 2, 3)]
        return np.concatenate([sum(w * x for w, x in zip(column, one) if w) for column in columns], axis=1)

    # the product of both is 2 for equal grades and -1 for others
    @cached_property
    def same_a(self) -> np.ndarray:
        return self._of_grades((1, 0, -1), (0, 1, -1))

    @cached_property
    def same_b(self) -> np.ndarray:
        return self._of_grades((2, -1, -1), (-1, 2, -1))

    @cached_property
    def wide(self) -> np.ndarray:
        return self.temps.astype(np.float64)

    @cached_property
    def there(self) -> np.ndarray:
        return self.known.astype(np.float64)

    @cached_property
    def powers(self) -> np.ndarray:
        """Squares, and where both fit temperatures above them."""
        return self.wide * (self.wide + (1 << self.step)) if self.step else self.wide * self.wide

    @cached_property
    def by_day(self) -> tuple[np.ndarray, np.ndarray]:
        """Temperatures and masks by day, with a last day that no station knows."""
        days, mask = np.zeros((2, self.temps.shape[1] + 1, len(self.temps)), self.temps.dtype)
        days[:-1], mask[:-1] = self.temps.T, -self.known.view(np.int8).T
        return days, mask


def _step(days: Days) -> int:
    """Bits of a sum of squares, if the sum of temperatures fits above it."""
    count = max(len(days.columns), 1)
    bits = (count * days.span * days.span).bit_length()
    return bits if (count * days.span + 1) << bits < EXACT64 else 0


def _open(tiles: list[tuple[dict, np.ndarray]], count: int, days: Days) -> Side:
    """Tiles side by side. A tile comes with the places of its stations."""
    kind = np.int16 if days.span <= 32767 else np.int32
    chosen = [_columns(days, k) for k in range(len(days.periods))]
    temps, known, grades = (np.zeros((count, len(days.columns)), x) for x in (kind, bool, np.int8))
    for tile, places in tiles:
        at = days.periods.index(tile["period"])
        first, own = chosen[at]
        held = _known(tile)
        part, grade = np.zeros(held.shape, kind), np.zeros(held.shape, np.int8)
        part[held] = _opened(tile["temps"]).astype(np.int64) + (tile["low"] - days.low)
        grade[held] = _opened(tile["grades"])
        for whole, x in ((temps, part), (known, held), (grades, grade)):
            whole[places, first : first + len(own)] = x[:, own]
    return Side(temps, known, grades, _step(days))


def _columns(days: Days, k: int) -> tuple[int, np.ndarray]:
    """Place of the first column of a period, and its columns."""
    first, end = np.searchsorted(days.columns, [k * DAYS, (k + 1) * DAYS])
    return int(first), days.columns[first:end] - k * DAYS


def _known(tile: dict) -> np.ndarray:
    return np.unpackbits(_opened(tile["known"]), count=len(tile["ids"]) * DAYS).reshape(-1, DAYS).view(bool)


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T).astype(np.int64)


def _gaps(a: Side, b: Side, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and maxima of absolute gaps are no product: one station at a time, over the days it knows. Sixteen bits hold a
    gap, and the sum of a few."""
    temps, mask = b.by_day
    kind, nothing = temps.dtype, len(temps) - 1
    few = min(32767 // max(span, 1), 64) if kind == np.int16 else 1
    size = few * max(GAP_ROWS // few, 1)
    gap, held = np.empty((2, size, len(b.temps)), kind)
    sums, widest = np.zeros((len(a.temps), len(b.temps)), np.int64), np.zeros((len(a.temps), len(b.temps)), kind)
    for i in range(len(a.temps)):
        days = np.flatnonzero(a.known[i])
        days, own = (np.append(x, np.full(-len(days) % few, y, x.dtype)) for x, y in ((days, nothing), (a.temps[i, days], 0)))
        for k in range(0, len(days), size):  # as many days at once as the processor's cache holds
            some = days[k : k + size]
            x, m = gap[: len(some)], held[: len(some)]
            np.take(temps, some, axis=0, out=x, mode="clip")
            np.subtract(x, own[k : k + size, None], out=x)
            np.abs(x, out=x)
            np.take(mask, some, axis=0, out=m, mode="clip")
            np.bitwise_and(x, m, out=x)
            np.maximum(widest[i], np.maximum.reduce(x, axis=0), out=widest[i])
            if few > 1:
                x = np.add.reduce(x.reshape(-1, few, x.shape[1]), axis=1, dtype=kind)
            sums[i] += x.sum(axis=0, dtype=np.int64)
    return sums, widest


def _meet(a: Side, b: Side, days: Days) -> dict[str, np.ndarray]:
    """Sums over some days for all pairs of two sides."""
    gaps, widest = _gaps(a, b, days.span)
    n = _product(a.counted, b.counted)
    graded = n if a.whole and b.whole else _product(a.graded, b.graded)
    out = {"n": n, "differ": (2 * graded - _product(a.same_a, b.same_b)) // 3, "gaps": gaps, "widest": widest, "ab": _product(a.wide, b.wide)}
    step = _step(days)
    for t, powers in (("a", _product(a.powers, b.there)), ("b", _product(a.there, b.powers))):
        out[t + t] = powers & ((1 << step) - 1) if step else powers
        out[t] = powers >> step if step else _product(a.wide, b.there) if t == "a" else _product(a.there, b.wide)
    return out


def _rounded(x: np.ndarray) -> np.ndarray:
    """Thousandths of ``x``, rounded as Spark does: half up on the shortest decimal that stands for the number."""
    scaled = np.abs(x) * 1000
    whole = np.floor(scaled + 0.5)
    near = np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6)
    if len(near):
        close, place = np.unique(np.abs(x[near]), return_inverse=True)
        exact = [int(Decimal(repr(float(v))).quantize(Decimal("0.001"), ROUND_HALF_UP).scaleb(3)) for v in close]
        whole[near] = np.array(exact, float)[place]
    return np.where(x < 0, -whole, whole).astype(np.int64)


def _over(part: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (2 * part + n) // (2 * n)


def _share(differ: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Tenths of a percent."""
    return _over(1000 * differ, n)


def _finished(s: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Tenths and thousandths of a pair from its sums, halves rounded up."""
    n = s["n"]
    covariance = (n * s["ab"] - s["a"] * s["b"]).astype(np.float64)
    spread = np.sqrt((n * s["aa"] - s["a"] ** 2).astype(np.float64)) * np.sqrt((n * s["bb"] - s["b"] ** 2).astype(np.float64))
    flat = spread == 0
    corr = np.where(flat, NO_VALUE, _rounded(covariance / np.where(flat, 1, spread)))
    return {"n": n, "avg": _over(s["gaps"], n), "widest": s["widest"], "differ": s["differ"], "pct": _share(s["differ"], n), "corr": corr}


class Listed(NamedTuple):
    """Stations with the names they are listed with: ``names[start[i]:start[i] + count[i]]`` belong to ``ids[i]``."""

    ids: pa.Array
    start: np.ndarray
    count: np.ndarray
    names: pa.Array


def _listed(ids: pa.Array, names: pa.ListArray) -> Listed:
    count = names.value_lengths().to_numpy().astype(np.int64)
    return Listed(ids, np.cumsum(count) - count, count, names.flatten())


def _pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Listed, dict[str, np.ndarray]]]:
    """All tile pairs of one cell: blocks of its row with blocks of its column, SIDE_STATIONS at a time. Gives the stations
    of the cell, in order, and finished pairs with the places of their stations, the smaller one first."""
    tiles = [t for batch in batches for t in batch.to_pylist()]
    row, column = tiles[0]["row"], tiles[0]["col"]
    names = {s["id"]: s["names"] for t in tiles for s in t["stations"]}
    ids = sorted({i for t in tiles for i in t["ids"]})
    listed, place = _listed(pa.array(ids, pa.string()), pa.array([names[i] for i in ids], pa.list_(pa.string()))), {i: k for k, i in enumerate(ids)}
    blocks: dict[int, list[dict]] = {}
    for t in tiles:
        blocks.setdefault(t["block"], []).append(t)

    def sides(side: int) -> list[tuple[np.ndarray, list[dict]]]:
        """Groups of blocks: the places of their stations, and their tiles."""
        groups: list[tuple[set, list[dict]]] = []
        for block in sorted(blocks):
            if blocks[block][0]["side"] == side:
                own = {place[i] for t in blocks[block] for i in t["ids"]}
                if not groups or len(groups[-1][0]) + len(own) > max(SIDE_STATIONS, len(own)):
                    groups.append((set(), []))
                groups[-1][0].update(own)
                groups[-1][1].extend(blocks[block])
        return [(np.array(sorted(places)), held) for places, held in groups]

    spans = _spans(tiles)

    def opened(group: tuple[np.ndarray, list[dict]]) -> list[Side]:
        places, held = group
        put = [(t, np.searchsorted(places, [place[i] for i in t["ids"]])) for t in held]
        return [_open([x for x in put if x[0]["period"] in days.periods], len(places), days) for days in spans]

    rows, columns = sides(row), sides(column)
    kept: dict[int, list[Side]] = {}
    for x, (xs, held) in enumerate(rows):
        here = [s.afresh() for s in kept[x]] if row == column and x in kept else opened((xs, held))
        for y, (ys, others) in enumerate(columns):
            if row == column and y < x:
                continue
            there = here if row == column and x == y else kept.get(y) or opened((ys, others))
            if len(columns) * len(spans) <= HELD_SIDES:
                kept[y] = [s.afresh() for s in there]
            sums = reduce(_added, map(_meet, here, there, spans))
            met = sums["n"] > 0
            i, j = np.nonzero(np.triu(met, 1) if there is here else met)
            del there  # its forms are not needed while pairs are handed on
            if len(i):
                a, b, sums = xs[i], ys[j], {k: sums.pop(k)[i, j] for k in list(sums)}
                yield listed, {"a": np.minimum(a, b), "b": np.maximum(a, b)} | _finished(sums)


def _spans(tiles: list[dict]) -> list[Days]:
    """The days of a cell, TOGETHER periods at a time."""
    low, high = min(t["low"] for t in tiles), max(t["high"] for t in tiles)
    periods, spans = sorted({t["period"] for t in tiles}), []
    for k in range(0, len(periods), TOGETHER):
        some = periods[k : k + TOGETHER]
        seen = np.zeros((len(some), DAYS), bool)
        for t in tiles:
            if t["period"] in some:
                seen[some.index(t["period"])] |= _known(t).any(axis=0)
        spans.append(Days(some, np.flatnonzero(seen.ravel()), low, high - low))
    return spans


def _added(sums: dict, more: dict) -> dict:
    return {k: np.maximum(v, more[k]) if k == "widest" else v + more[k] for k, v in sums.items()}


def _rows(listed: Listed, p: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Pairs with the names of both stations; a station listed more than once gives a row for each of its names."""
    first, second = listed.start[p["a"]], listed.start[p["b"]]
    if (listed.count != 1).any():
        each = listed.count[p["b"]]
        times = listed.count[p["a"]] * each
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        p, each = {k: np.repeat(v, times) for k, v in p.items()}, np.repeat(each, times)
        first, second = np.repeat(first, times) + at // each, np.repeat(second, times) + at % each
    for k in range(0, len(first), 65536):
        q = {name: v[k : k + 65536] for name, v in p.items()}
        columns = {
            "station_a": listed.ids.take(pa.array(q["a"])), "station_b": listed.ids.take(pa.array(q["b"])),
            "station_a_name": listed.names.take(pa.array(first[k : k + 65536])),
            "station_b_name": listed.names.take(pa.array(second[k : k + 65536])),
            "compared_days": pa.array(q["n"], pa.int64()), "avg_temp_diff_f": pa.array(q["avg"] / 10),
            "max_temp_diff_f": pa.array(q["widest"] / 10), "score_disagree_days": pa.array(q["differ"], pa.int64()),
            "pct_disagree": pa.array(q["pct"] / 10),
            "temp_correlation": pa.array(q["corr"] / 1000, mask=q["corr"] == NO_VALUE),
        }
        yield pa.RecordBatch.from_pydict(columns)


def _cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task holds the packed tiles of a cell and the pairs of SIDE_STATIONS with SIDE_STATIONS."""
    for listed, found in _pairs_of(batches):
        yield from _rows(listed, found)


def _key(pct: np.ndarray, place: np.ndarray, places: int) -> np.ndarray:
    """Rises as the share of disagreement falls, then with the place of the first station."""
    return (1000 - pct) * (places + 1) + place


def _dealer(bounds: list[tuple[int, str]]):
    """Step that leaves the pairs of a cell in packed runs, one for each part of an ordered result. ``bounds`` are the first
    share and station of every part but the first."""

    def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = sorted({station for _, station in bounds})
        edges = _key(np.array([pct for pct, _ in bounds], np.int64), np.array([2 * bisect_left(cut, s) + 1 for _, s in bounds], np.int64), 2 * len(cut))
        cell: list[dict[str, np.ndarray]] = []
        waiting, listed = 0, None
        for listed, p in _pairs_of(batches):
            cell.append({k: p[k].astype(np.int32) for k in _WHOLE} | {"part": _parts(listed, p, cut, edges)})
            waiting += len(p["n"])
            if waiting >= RUN_PAIRS:
                yield _in_runs(listed, cell)
                waiting, cell = 0, []
        if cell:
            yield _in_runs(listed, cell)

    return _runs


def _parts(listed: Listed, p: dict[str, np.ndarray], cut: list[str], edges: np.ndarray) -> np.ndarray:
    # odd places: stations with which a part may begin; even ones: what lies between them
    at = [(bisect_left(cut, i), i) for i in listed.ids.to_pylist()]
    place = np.array([2 * k + (k < len(cut) and cut[k] == i) for k, i in at], np.int64)
    return np.searchsorted(edges, _key(p["pct"], place[p["a"]], 2 * len(cut)), side="right").astype(np.min_scalar_type(len(edges)))


def _in_runs(listed: Listed, cell: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
    p = {k: np.concatenate([c.pop(k) for c in cell]) for k in list(cell[0])}
    order = np.argsort(p["part"], kind="stable")
    ends = np.flatnonzero(np.append(np.diff(p["part"][order].astype(np.int64)) != 0, True)) + 1
    parts, runs = [], []
    for own in np.split(order, ends[:-1]):
        parts.append(int(p["part"][own[0]]))
        runs.append(_packed(listed, {k: p[k][own] for k in _WHOLE}))
    return pa.RecordBatch.from_pydict({"part": pa.array(parts, pa.int32()), "run": pa.array(runs, pa.binary())})


def _packed(listed: Listed, p: dict[str, np.ndarray]) -> bytes:
    there = np.zeros(len(listed.ids), bool)
    there[p["a"]] = there[p["b"]] = True
    place = np.cumsum(there) - 1
    whole = p | {"a": place[p["a"]], "b": place[p["b"]], "corr": p["corr"] + NO_VALUE}
    used = pa.array(np.flatnonzero(there))
    names = pa.ListArray.from_arrays(pa.array(np.append(listed.start, len(listed.names)), pa.int32()), listed.names)
    stations = pa.RecordBatch.from_pydict({"id": listed.ids.take(used), "names": names.take(used)})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, stations.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(stations)
    return pickle.dumps((sink.getvalue().to_pybytes(), [_squeezed(whole[k]) for k in _WHOLE]))


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One part of an ordered result: the pairs of its runs, about ORDERED_PAIRS, in order."""
    runs = [pickle.loads(r) for batch in batches for r in batch["run"].to_pylist()]
    if not runs:
        return
    tables = [pa.ipc.open_stream(s).read_all() for s, _ in runs]
    stations, starts = pa.concat_tables(tables), np.cumsum([0] + [len(t) for t in tables])
    coded = stations["id"].combine_chunks().dictionary_encode()
    coded = coded.unify_dictionaries().combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    codes, order = coded.indices.to_numpy(), pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order))
    place = rank[codes]
    firsts = np.empty(len(order), np.int64)
    firsts[place[::-1]] = np.arange(len(place))[::-1]
    names = stations["names"].combine_chunks().take(pa.array(firsts))
    listed = _listed(coded.dictionary.take(order), names)
    p = {k: np.concatenate([_opened(r[i]).astype(np.int32) for _, r in runs]) for i, k in enumerate(_WHOLE)}
    own = np.repeat(starts[:-1], [int.from_bytes(r[0][1:9], "little") for _, r in runs])
    p |= {"a": place[own + p["a"]], "b": place[own + p["b"]], "corr": p["corr"] - NO_VALUE}
    p["pct"] = _share(p["differ"].astype(np.int64), p["n"])
    wide = len(rank)
    if 1001 * wide * wide < 1 << 62:
        order = np.argsort(((1000 - p["pct"]) * wide + p["a"]) * wide + p["b"])
    else:
        order = np.lexsort((p["b"], p["a"], -p["pct"]))
    yield from _rows(listed, {k: p.pop(k)[order] for k in list(p)})


def _blocks_of(stations: DataFrame, within: str | None, station_blocks: int | None) -> DataFrame:
    """(station_id, team, blocks, block): stations meet inside their team, which is cut into blocks by hash."""
    known = stations.select("station_id", (F.col(within) if within else F.lit("")).cast("string").alias("team")).distinct()
    if station_blocks is None:
        sizes = known.groupBy(F.col("team").alias("_team")).agg(F.ceil(F.count("*") / BLOCK_STATIONS).cast("int").alias("blocks"))
        known = known.join(sizes, F.col("team").eqNullSafe(F.col("_team"))).drop("_team")
    else:
        known = known.withColumn("blocks", F.lit(station_blocks))
    return known.withColumn("block", F.pmod(F.xxhash64("station_id"), F.col("blocks")).cast("int"))


def _sent(daily: DataFrame, stations: DataFrame, station_blocks: int | None, within: str | None) -> DataFrame:
    """Tiles with the stations of their block, one copy for each cell (team, row, col)."""
    ship_package(daily.sparkSession)
    year = F.year("observation_date")
    days = daily.filter(F.col("temp_max_f").isNotNull()).select(
        "station_id",
        F.floor(year / TILE_YEARS).cast("int").alias("period"),
        (F.pmod(year, F.lit(TILE_YEARS)) * 366 + F.dayofyear("observation_date") - 1).alias("day"),
        tenths(F.col("temp_max_f")).alias("t"),
        F.coalesce(severity_of(F.col("pour_score")), F.lit(0)).alias("sev"),
    )
    placed = days.join(_blocks_of(stations, within, station_blocks), "station_id")
    tiles = placed.groupBy("team", "block", "period").applyInArrow(_tile, _TILE_SCHEMA)
    # names stay with the blocks: a station and the names it is listed with, as many as it is listed
    listed = stations.groupBy("station_id").agg(F.collect_list(F.struct("name")).alias("names"))
    known = _blocks_of(stations, within, station_blocks).join(listed, "station_id")
    held = known.groupBy("team", "block").agg(
        F.collect_list(F.struct(F.col("station_id").alias("id"), F.transform("names", lambda n: n["name"]).alias("names"))).alias("stations")
    ).select(F.col("team").alias("_team"), F.col("block").alias("_block"), "stations")
    tiles = tiles.join(held, F.col("team").eqNullSafe(F.col("_team")) & (F.col("block") == F.col("_block"))).drop("_team", "_block")
    side = F.least(F.lit(CELL_BLOCKS), F.ceil(F.col("blocks") / CELLS)).cast("int")
    own, other = F.floor(F.col("block") / side).cast("int").alias("side"), F.col("other")
    return tiles.select("*", own, F.floor((F.col("blocks") - 1) / side).cast("int").alias("most")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("most")))
    ).withColumns({"row": F.least("side", other), "col": F.greatest("side", other)}).drop("other", "most")


def station_pairs(
    daily: DataFrame, stations: DataFrame, station_blocks: int | None = None, within: str | None = None, ordered: bool = False
) -> DataFrame:
    """Mean and largest temperature gap, verdict disagreement and correlation for every station pair.

    A task holds the packed tiles of one cell, 2 x CELL_BLOCKS blocks of about BLOCK_STATIONS stations at most, however
    many stations there are, since the number of blocks follows from their count; ``station_blocks`` fixes it instead. A
    day is shuffled once, into its tile; a tile is copied once per cell of its row and column, compressed. A
    pair is finished when it leaves the task, with its names, so pairs are never shuffled. ``within``
    names a column of ``stations``, such as ``state``: then only stations with the same value meet (NULL is a value of
    its own), and neither the work nor the result grows with the square of all stations. A station has one such value.

    ``ordered``: by falling share of days with another verdict, then by the ids of both stations. Pairs then leave their
    cell in packed runs, one for each part of the result, and every part puts its own in order.
    """
    sent = _sent(daily, stations, station_blocks, within).groupBy("team", "row", "col")
    if not ordered:
        return sent.applyInArrow(_cell, _PAIR_SCHEMA)
    bounds = _bounds(daily, stations, within)
    runs = sent.applyInArrow(_dealer(bounds), "part int, run binary")
    return runs.repartitionById(len(bounds) + 1, F.col("part")).mapInArrow(_ordered, _PAIR_SCHEMA)


def _bounds(daily: DataFrame, stations: DataFrame, within: str | None) -> list[tuple[int, str]]:
    """First share (in tenths) and station of every part but the first, so that parts hold about ORDERED_PAIRS. They are
    taken from the pairs of some stations, LOOKED_AT pairs for each part, as Spark takes the bounds of a sort from some
    rows; finding them from all pairs would mean to compare all stations twice. Whatever the bounds, no pair is lost."""
    team = F.col(within) if within else F.lit("")
    sizes = stations.select("station_id", team.alias("team")).distinct().groupBy("team").agg(F.count("*").cast("double").alias("n"))
    pairs = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    parts = -(-int(pairs) // ORDERED_PAIRS)
    if parts < 2:
        return []
    share = min(1.0, (parts * LOOKED_AT / pairs) ** 0.5)
    some = stations.filter(F.pmod(F.xxhash64(F.lit("bounds"), "station_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    seen = station_pairs(daily, some, within=within).select("pct_disagree", "station_a").toArrow()
    keys = sorted(zip((-np.rint(seen["pct_disagree"].to_numpy() * 10)).astype(int).tolist(), seen["station_a"].to_pylist()))
    cuts = {keys[len(keys) * k // parts] for k in range(1, parts)} if keys else set()
    return [(-pct, station) for pct, station in sorted(cuts)]
